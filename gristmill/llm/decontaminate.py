"""Benchmark decontamination by latent semantic retrieval, verified by longest common subsequences.

1. The benchmark's words are the vocabulary; one scan counts in how many documents each occurs.
   Words of more than ``common`` of all documents are left out of the vectors.
2. Documents are cut into overlapping passages of ``PASSAGE`` words.  A distributed randomised SVD
   of the TF-IDF matrix of all passages (and of the benchmark's items, so that each is
   represented) finds a latent space: every task multiplies its passages with a random matrix and
   back, the products are summed in two levels, and the driver orthonormalises the sum, whose
   size follows from the vocabulary alone.
3. A passage whose projection has a cosine of at least ``cosine`` with that of an item is a
   candidate, checked at once against the words around it: the longest common subsequence must
   reach ``copied`` of the item's words, or ``paraphrased`` of them when the item's answer (its
   rarest words, where no answer is given) is there too.
4. So is, whatever its cosine, a stretch of one or two passages that holds enough of the item's
   words, common ones too, counted exactly.  It is checked in the same way, but the subsequence
   must have ``LEAST_WORDS`` words and lie in a stretch of twice the item's length; every copy or
   paraphrase no longer than one and a half times the item lies in such a stretch.
   Items of more than ``PASSAGE`` words are compared by their own passages (cosine) and pieces
   (counts); the subsequence is still that of the whole item.

The benchmark is worked on in blocks of ``ITEMS`` passages of items (a longer item is a block of
its own), so that what is broadcast is bounded.
Nothing is shuffled but counts, sums and findings.

Defined results: null and empty texts match nothing; items with fewer than ``LEAST_WORDS`` words
identify nothing and are never found; a repeated row or item gives the same finding once; rows
without a doc_id are not reported by ``contaminated`` and kept by ``keep_clean`` only if
they are clean; an empty table gives an empty table; other columns are ignored and kept.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gristmill.llm import blobs
from gristmill.llm import windows as win
from gristmill.llm.shared import saved, session_of

cloudpickle.register_pickle_by_value(sys.modules[__name__])

PASSAGE, STRIDE, AROUND = 64, 32, 32
ITEMS, LEAST_WORDS, EXTRA, TERM_BLOCK = 256, 5, 16, 64
ANSWER_WORDS = 5
#: One and a half times an item of so many words lies in one passage, wherever it begins.
SHORT = 22
ROUNDING = 1e-9
#: Entries that are multiplied at once, and bytes of text: their rows of numbers stay in a core's cache.
SLICE, CHUNK = 2_000, 1 << 20


@dataclass(frozen=True)
class Thresholds:
    cosine: float = 0.35
    copied: float = 0.7
    paraphrased: float = 0.45
    answer: float = 0.6
    common: float = 0.05


@dataclass
class Space:
    """The vocabulary of a block of items (sorted hashes), term weights and, once fitted, a basis."""

    vocabulary: np.ndarray
    item_ids: list
    item_terms: list[np.ndarray]  # places in the vocabulary, in the item's order
    answers: list[np.ndarray]
    weights: np.ndarray
    basis: np.ndarray
    items: np.ndarray  # one row for each passage of an item, item by item
    pieces: np.ndarray  # item, begin, end of the pieces whose words are counted
    counts: np.ndarray  # how often each piece holds each word of the vocabulary
    in_answer: np.ndarray  # whether each item's answer holds it

    def lookup(self, hashes: np.ndarray) -> np.ndarray:
        """Places in the vocabulary, -1 for other words."""
        if not len(self.vocabulary):
            return np.full(len(hashes), -1)
        at = np.searchsorted(self.vocabulary, hashes)
        at[at == len(self.vocabulary)] = 0
        return np.where(self.vocabulary[at] == hashes, at, -1)


def words_of(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words (letters only, lower case), and where each text's words begin."""
    raw = win.lower_ascii()[raw]
    starts, ends, first = win.word_places(raw, at, win.no_letters())
    return win.word_hashes(raw, starts, ends), first


def _hashes(text: str | None) -> np.ndarray:
    data = (text or "").encode()
    return words_of(np.frombuffer(data, dtype=np.uint8), np.array([0, len(data)]))[0]


def blocks_of(benchmark: DataFrame, item: str, text: str, answer: str | None) -> Iterator[Space]:
    """The benchmark in blocks; only one block's items are on the driver at a time."""
    columns = [F.col(item).alias("item"), F.col(text).alias("text"),
               (F.col(answer) if answer else F.lit(None).cast("string")).alias("answer")]
    rows = saved(benchmark.select(*columns).where("item is not null and text is not null").distinct())
    number = max(1, math.ceil(rows.count() / ITEMS))
    for block in range(number):
        own = rows.where(F.pmod(F.xxhash64("item", "text"), F.lit(number)) == block).orderBy("item", "text").collect()
        hashed = [(r["item"], _hashes(r["text"]), _hashes(r["answer"])) for r in own]
        hashed = [h for h in hashed if len(h[1]) >= LEAST_WORDS]
        while hashed:
            total = np.cumsum([len(passages_of_item(len(h[1]))) for h in hashed])
            some = max(1, int(np.searchsorted(total, ITEMS, side="right")))
            yield _space(hashed[:some])
            hashed = hashed[some:]


def _space(hashed: list[tuple]) -> Space:
    vocabulary = np.unique(np.concatenate([w for _, words, answers in hashed for w in (words, answers)]))
    place = lambda w: np.searchsorted(vocabulary, w)
    none = np.zeros((0, 0), dtype=np.float32)
    pieces = []
    for i, (_, words, _) in enumerate(hashed):
        edges = np.linspace(0, len(words), -(-len(words) // PASSAGE) + 1).astype(int)
        pieces += [(i, a, b) for a, b in zip(edges[:-1], edges[1:])]
    return Space(vocabulary, [h[0] for h in hashed], [place(h[1]) for h in hashed],
                 [place(h[2]) for h in hashed], np.zeros(len(vocabulary)), none, none, np.array(pieces), none, none)


def passages_of_item(size: int) -> range:
    """Where the passages of an item of so many words begin."""
    return range(0, max(1, size - STRIDE), STRIDE)


def _counted(space: Space):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, texts = np.zeros(len(space.vocabulary), dtype=np.int64), 0
        for batch in batches:
            texts += batch.num_rows
            for row, end, raw, at in win.chunks(batch.column(0), CHUNK):
                hashes, first = words_of(raw, at)
                terms = space.lookup(hashes)
                known = np.flatnonzero(terms >= 0)
                of = np.repeat(np.arange(end - row), np.diff(first))[known]
                pairs = np.unique(of * len(counts) + terms[known])
                counts += np.bincount(pairs % len(counts), minlength=len(counts))
        found = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.append(found, -1).astype(np.int32)), pa.array(np.append(counts[found], texts))], ["term", "n"])

    return run


def weigh(space: Space, docs: DataFrame, common: float) -> None:
    """Inverse document frequencies over all documents; 0 for common words."""
    rows = docs.select("text").mapInArrow(_counted(space), "term int, n long")
    found = {r["term"]: r["n"] for r in rows.groupBy("term").agg(F.sum("n").alias("n")).collect()}
    texts = found.pop(-1, 0)
    counts = np.zeros(len(space.vocabulary))
    counts[list(found)] = list(found.values())
    rarity = np.log((1 + texts) / (1 + counts)) + 1.0
    space.weights = np.where(counts <= max(common * texts, 3), rarity, 0.0)
    for i, terms in enumerate(space.item_terms):
        if not len(space.answers[i]):
            distinct = np.unique(terms)
            rare = distinct[np.argsort(-rarity[distinct], kind="stable")][:ANSWER_WORDS]
            space.answers[i] = rare
        space.answers[i] = np.unique(space.answers[i])
    space.counts = np.zeros((len(counts), len(space.pieces)), dtype=np.uint8)
    space.in_answer = np.zeros((len(counts), len(space.item_ids)), dtype=np.uint8)
    for x, (i, begin, end) in enumerate(space.pieces):
        term, times = np.unique(space.item_terms[i][begin:end], return_counts=True)
        space.counts[term, x] = times
        space.in_answer[space.answers[i], i] = 1


def passages(space: Space, terms: np.ndarray, first: np.ndarray, every: bool = False):
    """TF-IDF entries of all passages of the texts, by passage: number, term, value; and where texts' passages begin.

    ``every``: also those of value 0.
    """
    counts = np.diff(first)
    windows = np.maximum(1, -(-counts // STRIDE))
    base = np.cumsum(windows) - windows
    place = np.flatnonzero((terms >= 0) & (every | (space.weights[np.maximum(terms, 0)] > 0)))
    of = np.searchsorted(first, place, side="right") - 1
    window = (place - first[of]) // STRIDE
    number = base[of] + window
    earlier = window > 0
    pairs = np.concatenate([number, number[earlier] - 1]) * len(space.vocabulary)
    pairs += np.concatenate([terms[place], terms[place[earlier]]])
    pairs, times = np.unique(pairs, return_counts=True)
    term = pairs % len(space.vocabulary)
    return pairs // len(space.vocabulary), term, (times * space.weights[term]).astype(np.float32), base


def slices(runs: np.ndarray, entries: int) -> Iterator[tuple[slice, slice, np.ndarray]]:
    """Runs of about SLICE entries together: which runs, which entries, where runs begin among these."""
    bounds, i = np.append(runs, entries), 0
    while i < len(runs):
        j = max(i + 1, int(np.searchsorted(bounds, bounds[i] + SLICE, side="right")) - 1)
        yield slice(i, j), slice(bounds[i], bounds[j]), bounds[i:j] - bounds[i]
        i = j


def _projected(number, term, value, basis):
    """Each passage's product with the basis; passages without entries are left out."""
    runs = blobs.runs(number)
    out = np.empty((len(runs), basis.shape[1]), dtype=np.float32)
    for some, part, heads in slices(runs, len(number)):
        out[some] = np.add.reduceat(value[part, None] * basis[term[part]], heads, axis=0)
    return number[runs], runs, out


def _back(space: Space, width: int, seed: int, salts: int):
    """Per task: the passages' transpose times their products with a random matrix, by blocks of terms."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        chance = random_matrix(space, width, seed)
        total = np.zeros((len(space.vocabulary), width), dtype=np.float32)
        for batch in batches:
            for _, _, raw, at in win.chunks(batch.column(0), CHUNK):
                hashes, first = words_of(raw, at)
                number, term, value, _ = passages(space, space.lookup(hashes), first)
                _, runs, product = _projected(number, term, value, chance)
                if len(runs):
                    of = np.repeat(np.arange(len(runs)), np.diff(np.append(runs, len(number))))
                    order = np.argsort(term, kind="stable")
                    heads = blobs.runs(term[order])
                    for some, part, inner in slices(heads, len(order)):
                        at_entry = order[part]
                        total[term[order[heads[some]]]] += np.add.reduceat(
                            value[at_entry, None] * product[of[at_entry]], inner, axis=0)
        salt = TaskContext.get().partitionId() % salts
        for a in range(0, len(total), TERM_BLOCK):
            part = total[a:a + TERM_BLOCK]
            if part.any():
                yield pa.RecordBatch.from_arrays(
                    [pa.array([a], pa.int32()), pa.array([salt], pa.int32()), pa.array([part.tobytes()])],
                    ["block", "salt", "sums"])

    return run


def random_matrix(space: Space, width: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).standard_normal((len(space.vocabulary), width), dtype=np.float32)


def _summed(rows: pd.DataFrame) -> pd.DataFrame:
    total = sum(np.frombuffer(s, dtype=np.float32).astype(np.float64) for s in rows["sums"])
    return pd.DataFrame({"block": [rows["block"].iloc[0]], "salt": [0], "sums": [total.astype(np.float32).tobytes()]})


def item_vectors(space: Space) -> np.ndarray:
    """TF-IDF vectors of the items' passages, of length one."""
    own = [terms[a:a + PASSAGE] for terms in space.item_terms for a in passages_of_item(len(terms))]
    out = np.zeros((len(own), len(space.vocabulary)), dtype=np.float32)
    for i, terms in enumerate(own):
        np.add.at(out[i], terms, space.weights[terms])
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)


def fit(space: Space, docs: DataFrame, seed: int = 17) -> None:
    """A basis of the latent space: randomised SVD of the passages and the items."""
    parts = sum(len(passages_of_item(len(terms))) for terms in space.item_terms)
    width = min(len(space.vocabulary), min(parts, ITEMS) + EXTRA)
    salts = max(1, math.isqrt(docs.rdd.getNumPartitions()))
    kind = "block int, salt int, sums binary"
    parts = docs.select("text").mapInArrow(_back(space, width, seed, salts), kind)
    parts = parts.groupBy("block", "salt").applyInPandas(_summed, kind).groupBy("block").applyInPandas(_summed, kind)
    total = np.zeros((len(space.vocabulary), width))
    for r in parts.toLocalIterator():
        rows = np.frombuffer(r["sums"], dtype=np.float32).reshape(-1, width)
        total[r["block"]:r["block"] + len(rows)] = rows
    items = item_vectors(space).astype(np.float64)
    # The items weigh as much as the whole corpus, so that the space represents each of them.
    weight = max(1.0, np.linalg.norm(total))
    total += weight * (items.T @ (items @ random_matrix(space, width, seed)))
    space.basis = np.linalg.qr(total)[0].astype(np.float32)
    inside = items.astype(np.float32) @ space.basis
    space.items = inside / np.maximum(np.linalg.norm(inside, axis=1, keepdims=True), 1e-12)


def common_subsequence(left: list[int], right: list[int]) -> int:
    """Length of the longest common subsequence (bit-parallel, Hyyrö 2004)."""
    masks: dict[int, int] = {}
    for i, x in enumerate(left):
        masks[x] = masks.get(x, 0) | (1 << i)
    full = (1 << len(left)) - 1
    row = full
    for x in right:
        hit = row & masks.get(x, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(left) - row.bit_count()


def _held(number: np.ndarray, term: np.ndarray, table: np.ndarray, windows: int) -> np.ndarray:
    """For each passage and column of the table the sum over the passage's distinct words, 255 at most."""
    runs = blobs.runs(number)
    if table.sum(axis=0, dtype=np.int64).max(initial=0) <= 255:  # no sum exceeds a byte: eight are added at once
        eights = np.zeros((len(table), -(-table.shape[1] // 8) * 8), dtype=np.uint8)
        eights[:, :table.shape[1]] = table
        eights = eights.view(np.uint64)
        out = np.zeros((windows, eights.shape[1]), dtype=np.uint64)
        for some, part, heads in slices(runs, len(number)):
            out[number[runs[some]]] = np.add.reduceat(eights[term[part]], heads, axis=0)
        return out.view(np.uint8)[:, :table.shape[1]]
    out = np.zeros((windows, table.shape[1]), dtype=np.uint8)
    for some, part, heads in slices(runs, len(number)):
        out[number[runs[some]]] = np.minimum(np.add.reduceat(table[term[part]], heads, axis=0, dtype=np.uint16), 255)
    return out


def _stretches(space: Space, limits: Thresholds, number, term, windows: int, of: np.ndarray, base: np.ndarray):
    """(passage, piece) where the words of the stretch that begins with the passage allow a finding."""
    sizes = space.pieces[:, 2] - space.pieces[:, 1]
    held = _held(number, term, space.counts, windows).astype(np.uint16)
    wide = sizes > SHORT
    held[:-2, wide] += held[2:, wide]
    which, piece = np.nonzero(held >= np.ceil(needed(limits, sizes)).astype(np.uint16))
    item, whole = space.pieces[piece, 0], np.array([len(w) for w in space.item_terms])
    # The answer must be around, unless so much is there that it is not asked for.
    answers = term if not len(term) else space.in_answer.any(axis=1)[term]
    keys = _held(number[answers], term[answers], space.in_answer, windows) if len(term) else held
    least, last = base[of[which]], windows - 1
    around = sum(keys[np.clip(which + step, least, last), item].astype(np.int64) for step in (-2, 0, 2, 4))
    enough = np.array([limits.answer * len(a) - ROUNDING for a in space.answers])
    possible = (held[which, piece] >= limits.copied * sizes[piece] - ROUNDING) | (around >= enough[item]) | (whole[item] > PASSAGE)
    return which[possible], piece[possible]


def needed(limits: Thresholds, size):
    """How many words in order make a paraphrase of an item of so many words."""
    return np.maximum(limits.paraphrased * size, LEAST_WORDS) - ROUNDING


def _most_hits(space: Space, terms: np.ndarray, begin: np.ndarray, end: np.ndarray, piece: np.ndarray) -> np.ndarray:
    """For each stretch how many words of its piece the fullest span of ``_dense_share`` holds; no subsequence is longer."""
    out = np.zeros(len(piece), dtype=np.int64)
    sizes = (space.pieces[:, 2] - space.pieces[:, 1])[piece]
    for size in np.unique(sizes).tolist():
        own, step = np.flatnonzero(sizes == size), -(-size // 2)
        for part in np.array_split(own, max(1, 8 * len(own) // SLICE)):
            place = begin[part, None] + np.arange(2 * PASSAGE)
            word = terms[np.minimum(place, len(terms) - 1)]
            hit = (place < end[part, None]) & (word >= 0) & (space.counts[word, piece[part, None]] > 0)
            before = np.zeros((len(part), 2 * PASSAGE + 1), dtype=np.int16)
            np.cumsum(hit, axis=1, out=before[:, 1:])
            starts = np.maximum(1, end[part] - begin[part] - 2 * size + step)
            for start in range(0, 2 * PASSAGE, step):
                here = before[:, min(start + 2 * size, 2 * PASSAGE)] - before[:, start]
                out[part] = np.maximum(out[part], np.where(start < starts, here, 0))
    return out


def _dense_share(words: np.ndarray, stretch: np.ndarray, held: np.ndarray, least: float) -> float:
    """The item's share of the longest common subsequence in a stretch of twice its length; 0 where it is below ``least`` words.

    ``held``: how often the item holds each word of the vocabulary; other words of the stretch match nothing.
    """
    size, step = 2 * len(words), -(-len(words) // 2)
    hits = np.flatnonzero((stretch >= 0) & (held[stretch] > 0))
    if len(hits) < least:
        return 0.0
    starts = np.arange(0, max(1, len(stretch) - size + step), step)
    low, high = np.searchsorted(hits, starts), np.searchsorted(hits, starts + size)
    spans = {(a, b) for a, b in zip(low.tolist(), high.tolist()) if b - a >= least}
    if not spans:
        return 0.0
    matching, own = stretch[hits].tolist(), words.tolist()
    best = max(common_subsequence(own, matching[a:b]) for a, b in spans)
    return best / len(own) if best >= least else 0.0


def _found(space: Space, limits: Thresholds, texts: pa.Array) -> Iterator[tuple[int, int, float, float, float]]:
    """(row, item, cosine, share of the subsequence, share of the answer) of every confirmed passage."""
    parts = np.array([len(passages_of_item(len(words))) for words in space.item_terms])
    heads = np.cumsum(parts) - parts
    whole_sizes = np.array([len(words) for words in space.item_terms])
    onto_items = space.basis @ space.items.T  # a passage's projection times the projected items, in one step
    for row, _, raw, at in win.chunks(texts, CHUNK):
        hashes, first = words_of(raw, at)
        terms = space.lookup(hashes)
        all_number, all_term, all_value, base = passages(space, terms, first, every=True)
        if not len(all_number):
            continue
        windows = int(base[-1] + max(1, -(-(first[-1] - first[-2]) // STRIDE)))
        text_of = np.searchsorted(base, np.arange(windows), side="right") - 1
        weighed = all_value > 0
        number, term, value = all_number[weighed], all_term[weighed], all_value[weighed]
        numbers, runs, near = _projected(number, term, value, onto_items)
        if len(runs):
            # A passage's own length counts whole, also what lies outside of the latent space.
            length = np.sqrt(np.add.reduceat(value * value, runs))
            near /= np.maximum(length, 1e-12)[:, None]
            if len(heads) < near.shape[1]:
                near = np.maximum.reduceat(near, heads, axis=1)
        which, item = np.nonzero(near >= limits.cosine)
        for w, i, text in zip(which.tolist(), item.tolist(), text_of[numbers[which]].tolist()):
            words = space.item_terms[i]
            around = max(AROUND, len(words))
            begin = first[text] + (numbers[w] - base[text]) * STRIDE
            region = terms[max(first[text], begin - around):min(first[text + 1], begin + PASSAGE + around)]
            share = common_subsequence(words.tolist(), region.tolist()) / len(words)
            if share < limits.paraphrased:
                continue
            answer = float(np.isin(space.answers[i], region).mean())
            if share >= limits.copied or answer >= limits.answer:
                yield row + text, i, float(near[w, i]), share, answer
        rows_of = np.full(windows, -1)
        rows_of[numbers] = np.arange(len(numbers))
        which, piece = _stretches(space, limits, all_number, all_term, windows, text_of, base)
        sizes, texts_of = (space.pieces[:, 2] - space.pieces[:, 1])[piece], text_of[which]
        begins = first[texts_of] + (which - base[texts_of]) * STRIDE
        ends = np.minimum(first[texts_of + 1], begins + np.where(sizes <= SHORT, PASSAGE, 2 * PASSAGE))
        hits, least = _most_hits(space, terms, begins, ends, piece), needed(limits, sizes)
        full = np.flatnonzero(hits >= least)
        which, piece, texts_of, begins, ends, hits, least = (
            x[full] for x in (which, piece, texts_of, begins, ends, hits, least))
        # The answer of an item that is one piece; without it, more words are asked for.
        items, lengths = space.pieces[piece, 0], whole_sizes[space.pieces[piece, 0]]
        margin = np.maximum(AROUND, lengths)
        short = lengths <= PASSAGE
        answers = _answers(space, terms, np.maximum(first[texts_of], begins - margin),
                           np.minimum(first[texts_of + 1], ends + margin), np.where(short, items, -1))
        least = np.where(short & (answers < limits.answer), np.maximum(least, limits.copied * lengths - ROUNDING), least)
        full = np.flatnonzero(hits >= least)
        whole: set[tuple[int, int]] = set()
        for w, x, text, least, answer in zip(*(y[full].tolist() for y in (which, piece, texts_of, least, answers))):
            i, before, after = space.pieces[x].tolist()
            words = space.item_terms[i]
            if (text, i) in whole:
                continue
            begin, end = first[text] + (w - base[text]) * STRIDE, first[text + 1]
            width = PASSAGE if after - before <= SHORT else 2 * PASSAGE
            around = max(AROUND, len(words))
            low, high = begin, begin + width
            share = _dense_share(words[before:after], terms[low:min(end, high)], space.counts[:, x], least)
            if not share:
                continue
            if len(words) > PASSAGE:  # a piece is there; now the whole item around it
                low, high = max(first[text], low - 2 * before), high + 2 * (len(words) - after)
                share = common_subsequence(words.tolist(), terms[low:min(end, high)].tolist()) / len(words)
                if share < limits.paraphrased:
                    continue
                answer = _answer_share(space, i, terms[max(first[text], low - around):min(end, high + around)])
            if share >= limits.copied or answer >= limits.answer:
                if share == 1.0 and len(words) > PASSAGE:
                    whole.add((text, i))
                yield row + text, i, float(near[rows_of[w], i]) if rows_of[w] >= 0 else 0.0, share, answer


def _answers(space: Space, terms: np.ndarray, begin: np.ndarray, end: np.ndarray, item: np.ndarray) -> np.ndarray:
    """For each stretch the share of its item's answer that is among the words; 0 for item -1."""
    lengths, out = np.array([len(a) for a in space.answers]), np.zeros(len(item))
    asked = np.flatnonzero(item >= 0)
    for part in np.array_split(asked, max(1, 8 * len(asked) // SLICE)):
        if len(part):
            place = begin[part, None] + np.arange((end[part] - begin[part]).max())
            word = terms[np.minimum(place, len(terms) - 1)]
            row, at = np.nonzero((place < end[part, None]) & (word >= 0) & (space.in_answer[word, item[part, None]] > 0))
            seen = np.unique(row * len(space.vocabulary) + word[row, at]) // len(space.vocabulary)
            out[part] = np.bincount(seen, minlength=len(part)) / lengths[item[part]]
    return out


def _answer_share(space: Space, i: int, region: np.ndarray) -> float:
    """The share of the item's answer that is among the words."""
    there = set(region.tolist())
    return sum(x in there for x in space.answers[i].tolist()) / len(space.answers[i])


def spaces(docs: DataFrame, benchmark: DataFrame, limits: Thresholds, item: str, text: str, answer: str | None):
    for space in blocks_of(benchmark, item, text, answer):
        weigh(space, docs, limits.common)
        fit(space, docs)
        yield space


def contaminated(
    docs: DataFrame, benchmark: DataFrame, limits: Thresholds = Thresholds(),
    item: str = "item_id", text: str = "text", answer: str | None = None,
) -> DataFrame:
    """``doc_id, item_id, cosine, common_words, answer_words`` for every benchmark item found in a document."""
    kind = "doc_id long, item_id long, cosine double, common_words double, answer_words double"
    docs = docs.select("doc_id", "text").where("doc_id is not null")
    out = session_of(docs).createDataFrame([], kind)
    for space in spaces(docs, benchmark, limits, item, text, answer):
        def run(batches: Iterator[pa.RecordBatch], space=space) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                ids = batch.column(0).to_pylist()
                rows = [(ids[r], space.item_ids[i], *rest)
                        for r, i, *rest in _found(space, limits, batch.column(1))]
                columns = list(zip(*rows)) or [[]] * 5
                kinds = (pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(columns, kinds)],
                    ["doc_id", "item_id", "cosine", "common_words", "answer_words"])

        out = out.union(docs.mapInArrow(run, kind))
    return out.groupBy("doc_id", "item_id").agg(
        F.max("cosine").alias("cosine"), F.max("common_words").alias("common_words"),
        F.max("answer_words").alias("answer_words"))


def keep_clean(docs: DataFrame, benchmark: DataFrame, limits: Thresholds = Thresholds(), **names) -> DataFrame:
    """The rows in which no benchmark item is found, with all their columns."""
    names = {"item": "item_id", "text": "text", "answer": None} | names
    kept = docs
    for space in spaces(docs, benchmark, limits, **names):
        kept = kept.where(~_leaks(space, limits)("text"))
    return kept


def _leaks(space: Space, limits: Thresholds):
    @F.pandas_udf("boolean")
    def leaks(texts: pd.Series) -> pd.Series:
        rows = {r for r, *_ in _found(space, limits, pa.array(texts, pa.string(), from_pandas=True))}
        return pd.Series([i in rows for i in range(len(texts))], dtype=bool)

    return leaks
