"""Alignment of two tokenizers' tokens by the bytes that both cover.

1. Texts are tokenised once, in Arrow batches.  A batch's tokens are flat lists with parent
   indices; segmented cumulative sums of their lengths give where each ends in its document.
2. An Acero join on document-end keys finds the ends that both tokenizers share; they cut the
   tokens into groups.  Groups of one token each are pairs as they stand; the others' distinct
   identifiers meet in a second join.  No occurrence pair is ever written out.
3. ``Table.group_by`` counts the documents of each pair of identifiers in a task; Spark merges the
   partial counts.  A chunk (documents in turn, bounded by their pairs) asks for each of its
   distinct pairs once, and the answers meet the chunk's packed documents by the chunk's number.

Defined results: a text that is null, empty, not UTF-8, or not given back byte for byte by either
tokenizer has no tokens (zeros, and an empty text for the hash).  Rows that repeat count as
documents each; an empty table gives an empty table; other columns are ignored.  A long text is cut
between words, where no token of either tokenizer can reach across; one without such a place is
worked on whole.
"""

from __future__ import annotations

import hashlib
import json
import re
import sys
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext, cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gristmill.functions.frames import lookup_join
from gristmill.llm.shared import saved, without

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Bytes of text that are worked on at once, and what closes a chunk: its distinct pairs, or the
#: pairs of its documents.  They bound memory only; results do not depend on them.
RUN, CHUNK_PAIRS, CHUNK_LINKS, SLICE = 1 << 21, 1_000_000, 4_000_000, 1 << 22
#: Units whose tokens a worker remembers before it starts afresh, and the longest that it remembers.
REMEMBERED, LONGEST = 500_000, 64
ALIGNED = (
    "chunk long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, "
    "codes array<int>, times array<long>, first int, a array<int>, b array<int>, n array<long>"
)
FIELDS = pa.schema([
    ("chunk", pa.int64()), ("doc_id", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()),
    ("n_groups", pa.int64()), ("n_links", pa.int64()), ("groups_sha256", pa.string()),
    ("codes", pa.list_(pa.int32())), ("times", pa.list_(pa.int64())), ("first", pa.int32()),
    ("a", pa.list_(pa.int32())), ("b", pa.list_(pa.int32())), ("n", pa.list_(pa.int64())),
])
RESULT = (
    "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, "
    "groups_sha256 string"
)


def byte_letters() -> dict[str, int]:
    """How byte-level vocabularies write a byte: printable ones as they are, the others from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Vocabulary:
    """The bytes of every token of a tokenizer, and its decimal names with each separator."""

    def __init__(self, tokens: list[bytes]) -> None:
        self.tokens = pa.array(tokens, pa.large_binary())
        self.sizes = np.array([len(t) for t in tokens], dtype=np.int64)
        self.names = pa.array([f"{i}{s}".encode() for i in range(len(tokens)) for s in ",|;"], pa.large_binary())


class ByteTokenizer:
    """A byte-level BPE from its JSON file, by the model's ranks; the JSON's own reader is the fallback."""

    def __init__(self, source: str) -> None:
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        letters = byte_letters()
        vocabulary = json.loads(source)["model"]["vocab"]
        special = {t["content"] for t in json.loads(source)["added_tokens"]}
        ranks = {bytes(letters[c] for c in token): i for token, i in vocabulary.items() if token not in special}
        tokens = [b""] * (max(vocabulary.values()) + 1)
        for token, i in ranks.items():
            tokens[i] = token
        self.vocabulary = Vocabulary(tokens)
        self.fast = tiktoken.Encoding(
            "ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.plain = Tokenizer.from_str(source)
        self.plain.encode_special_tokens = True

    def encode(self, text: str) -> np.ndarray:
        """The tokens of a space and the text."""
        text = " " + text
        try:
            return self.fast.encode_to_numpy(text, disallowed_special=()).astype(np.int32)
        except Exception:  # noqa: BLE001  runs of white space can exceed the pattern's backtracking
            return np.array(self.plain.encode(text, add_special_tokens=False).ids, dtype=np.int32)


class PieceTokenizer:
    """A sentencepiece model with byte fallback."""

    SPACE = "▁"

    def __init__(self, source: bytes) -> None:
        from sentencepiece import SentencePieceProcessor

        self.model = SentencePieceProcessor(model_proto=source)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        self.vocabulary = Vocabulary([
            bytes([int(p[3:5], 16)]) if self.model.is_byte(i) else p.replace(self.SPACE, " ").encode()
            for i, p in enumerate(pieces)])
        # A text may be cut before a space only if no piece reaches from a letter over a space.
        self.divisible = not any(self.SPACE in p.lstrip(self.SPACE) for p in pieces)

    def encode(self, text: str) -> np.ndarray:
        """The tokens of the text, to which the model adds the space in front."""
        return np.array(self.model.encode(text, num_threads=1), dtype=np.int32)


def sections(text: bytes, divisible: bool) -> list[bytes]:
    """A text with its leading space, cut before single spaces between ASCII letters every RUN bytes."""
    text = b" " + text
    if len(text) <= RUN or not divisible:
        return [text]
    raw = np.frombuffer(text, dtype=np.uint8)
    letter = ((raw | 32) >= 97) & ((raw | 32) <= 122)
    places = np.flatnonzero((raw[1:-1] == 32) & letter[:-2] & letter[2:]) + 1
    cuts, at = [0], 0
    while at + RUN < len(text):
        place = int(np.searchsorted(places, at + RUN))
        if place == len(places):
            break
        at = int(places[place])
        cuts.append(at)
    return [text[s:e] for s, e in zip(cuts, [*cuts[1:], len(text)])]


def _flat(lists: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Values and parent indices of a column of lists."""
    ends = np.cumsum([0, *map(len, lists)])
    column = pa.ListArray.from_arrays(
        pa.array(ends, pa.int32()), pa.array(np.concatenate([*lists, np.zeros(0, dtype=np.int32)]), pa.int32()))
    return column.flatten().to_numpy(), pc.list_parent_indices(column).to_numpy()


def _joined(vocabulary: pa.Array, ids: np.ndarray) -> tuple[memoryview, np.ndarray]:
    """The entries one after the other, and where each begins (and the end)."""
    taken = vocabulary.take(pa.array(ids))
    _, offsets, data = taken.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[:len(ids) + 1] if len(ids) else np.zeros(1, dtype=np.int64)
    return memoryview(data if data is not None else b"").cast("B")[:at[-1]], at


def _counted(table: pa.Table, keys: list[str], *sums: str) -> pa.Table:
    how = [(s, "sum") for s in sums] or [([], "count_all")]
    names = {f"{s}_sum": s for s in sums} | {"count_all": "n"}
    done = table.group_by(keys, use_threads=False).aggregate(how)
    return done.rename_columns([names.get(c, c) for c in done.column_names])


def _keys(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a.astype(np.int64) << 32) | b.astype(np.int64)


class Aligned:
    """The groups and pairs of some texts (or sections), whose tokens are whole."""

    def __init__(self, a_lists: list, b_lists: list, sizes: np.ndarray, a_words: Vocabulary, b_words: Vocabulary):
        self.texts = len(sizes)
        base = np.concatenate([[0], np.cumsum(sizes)])
        (a, a_doc), (b, b_doc) = _flat(a_lists), _flat(b_lists)
        a_end = self._ends(a, a_doc, a_words.sizes) + base[a_doc]
        b_end = self._ends(b, b_doc, b_words.sizes) + base[b_doc]
        both = pa.table({"end": a_end}).join(pa.table({"end": b_end}), "end", join_type="inner", use_threads=False)
        ends = np.sort(both["end"].to_numpy())
        a_group, b_group = np.searchsorted(ends, a_end), np.searchsorted(ends, b_end)
        self.group_doc = np.searchsorted(base, ends, side="left") - 1
        in_a = np.bincount(a_group, minlength=len(ends))
        in_b = np.bincount(b_group, minlength=len(ends))
        links = np.concatenate([[0], np.cumsum(in_a * in_b)])
        edge = np.searchsorted(self.group_doc, np.arange(self.texts + 1))
        self.n_a = np.bincount(a_doc, minlength=self.texts)
        self.n_b = np.bincount(b_doc, minlength=self.texts)
        self.n_groups, self.n_links = np.diff(edge), links[edge[1:]] - links[edge[:-1]]
        self.pairs = self._pairs(a, b, a_group, b_group, in_a, in_b)
        self.text, self.text_at = self._written(a, b, a_group, b_group, a_words, b_words)

    @staticmethod
    def _ends(ids: np.ndarray, doc: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Cumulative sums of the lengths, begun afresh at every document."""
        total = pc.cumulative_sum(pa.array(sizes[ids])).to_numpy()
        first = np.ones(len(ids), dtype=bool)
        first[1:] = doc[1:] != doc[:-1]
        heads = np.flatnonzero(first)
        before = (total[heads] - sizes[ids[heads]])
        return total - np.repeat(before, np.diff(np.append(heads, len(ids))))

    def _pairs(self, a, b, a_group, b_group, in_a, in_b) -> pa.Table:
        """``doc, pair, times``: the distinct pairs of identifiers of each text and how often they link."""
        lone = (in_a == 1) & (in_b == 1)
        lone_a, lone_b = lone[a_group], lone[b_group]
        found = [_counted(pa.table({
            "doc": self.group_doc[lone], "pair": _keys(a[lone_a], b[lone_b])}), ["doc", "pair"])]
        left = _counted(pa.table({"group": a_group[~lone_a], "a": a[~lone_a]}), ["group", "a"])
        right = _counted(pa.table({"group": b_group[~lone_b], "b": b[~lone_b]}), ["group", "b"])
        many = np.bincount(left["group"].to_numpy(), minlength=len(in_a)) * np.bincount(
            right["group"].to_numpy(), minlength=len(in_a))
        total = np.cumsum(many)
        at = 0
        while at < len(total):
            # Whole groups, as many as keep a join's result near SLICE rows.
            end = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + SLICE, side="right")))
            inside = (pc.field("group") >= at) & (pc.field("group") < end)
            met = left.filter(inside).rename_columns(["group", "a", "a_n"]).join(
                right.filter(inside).rename_columns(["group", "b", "b_n"]), "group", join_type="inner",
                use_threads=False)
            found.append(_counted(pa.table({
                "doc": self.group_doc[met["group"].to_numpy()], "pair": _keys(met["a"].to_numpy(), met["b"].to_numpy()),
                "n": pc.multiply(met["a_n"], met["b_n"])}), ["doc", "pair"], "n"))
            at = end
        return _counted(pa.concat_tables([t.select(["doc", "pair", "n"]) for t in found]), ["doc", "pair"], "n")

    def _written(self, a, b, a_group, b_group, a_words, b_words) -> tuple[memoryview, np.ndarray]:
        """``a1,a2|b1;...`` of all texts, and where each text's part begins; each ends in ``;``."""
        names = pa.concat_arrays([a_words.names, b_words.names])
        a_last = np.append(a_group[1:] != a_group[:-1], True)[:len(a)]
        b_last = np.append(b_group[1:] != b_group[:-1], True)[:len(b)]
        entry = np.concatenate([a * 3 + a_last, len(a_words.names) + b * 3 + 2 * b_last])
        order = np.argsort(np.concatenate([a_group * 2, b_group * 2 + 1]), kind="stable")
        text, at = _joined(names, entry[order])
        tokens = np.concatenate([[0], np.cumsum(self.n_a + self.n_b)])
        return text, at[tokens]


class Chunk:
    """The pairs of a chunk's documents: a code for each, and how many of its documents hold it."""

    def __init__(self, name: int) -> None:
        self.name, self.links = name, 0
        self.pairs = np.zeros(0, dtype=np.int64)     # ascending
        self.codes = np.zeros(0, dtype=np.int32)     # of the pairs, in that order
        self.counts = np.zeros(0, dtype=np.int64)    # by code

    def add(self, table: pa.Table) -> np.ndarray:
        """Count ``doc, pair`` rows, each a document that holds the pair; their codes."""
        self.links += table.num_rows
        partial = _counted(table, ["pair"]).sort_by("pair")
        pairs, count = partial["pair"].to_numpy(), partial["n"].to_numpy()
        fresh = pairs[~np.isin(pairs, self.pairs, assume_unique=True)]
        codes = np.concatenate([self.codes, len(self.pairs) + np.arange(len(fresh), dtype=np.int32)])
        every = np.concatenate([self.pairs, fresh])
        order = np.argsort(every, kind="stable")
        self.pairs, self.codes = every[order], codes[order]
        self.counts = np.concatenate([self.counts, np.zeros(len(fresh), dtype=np.int64)])
        self.counts[self.codes[np.searchsorted(self.pairs, pairs)]] += count
        return self.codes[np.searchsorted(self.pairs, table["pair"].to_numpy())]

    def full(self) -> bool:
        return len(self.pairs) >= CHUNK_PAIRS or self.links >= CHUNK_LINKS

    def rows(self) -> Iterator[pa.RecordBatch]:
        by_code = np.empty(len(self.pairs), dtype=np.int64)
        by_code[self.codes] = self.pairs
        for first in range(0, len(by_code), 1 << 16):
            pairs = by_code[first:first + (1 << 16)]
            yield _batch({
                "chunk": [self.name], "first": [first], "a": [(pairs >> 32).astype(np.int32)],
                "b": [(pairs & 0xFFFFFFFF).astype(np.int32)], "n": [self.counts[first:first + (1 << 16)]]}, 1)


def _batch(columns: dict, rows: int) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([
        (columns[f.name] if isinstance(columns[f.name], pa.Array) else pa.array(columns[f.name], f.type))
        if f.name in columns else pa.nulls(rows, f.type) for f in FIELDS], schema=FIELDS)


class Aligner:
    """Both tokenizers; a worker builds them once."""

    def __init__(self, a_source: str, b_source: bytes) -> None:
        self.a, self.b = ByteTokenizer(a_source), PieceTokenizer(b_source)
        # Neither tokenizer joins anything over a single space between other characters, so a text
        # falls into units there, each with the space before it; common units are remembered.
        self.units = re.compile(r"(?<=\S) (?=\S)" if self.b.divisible else r"(?!)")
        self.known: dict[str, tuple[bytes, bytes] | None] = {}

    def learn(self, units: list[str]) -> None:
        """Tokens of units by both tokenizers, or none where either does not give the bytes back."""
        plain = [u for u in units if u and not u[0].isspace() and not u[-1].isspace()] if self.b.divisible else []
        self._learn_joined(plain)
        for unit in units:
            if unit not in self.known:
                self._learn_joined([unit])
                self.known.setdefault(unit, None)

    def _learn_joined(self, units: list[str]) -> None:
        """Encode units as one text, whose tokens fall apart again at the units' ends."""
        text = " ".join(units)
        sizes = np.array([len(u.encode()) + 1 for u in units], dtype=np.int64)
        cut = []
        for tokenizer in (self.a, self.b):
            ids, words = tokenizer.encode(text), tokenizer.vocabulary
            if not units or _joined(words.tokens, ids)[0] != b" " + text.encode():
                return
            ends = np.searchsorted(np.cumsum(words.sizes[ids]), np.cumsum(sizes)) + 1
            blob, places = ids.tobytes(), [0, *(4 * ends).tolist()]
            cut.append([blob[s:e] for s, e in zip(places, places[1:])])
        self.known.update(zip(units, zip(*cut)))

    def tokens(self, texts: list[bytes]) -> list[tuple[np.ndarray, np.ndarray] | None]:
        """The tokens of each text (or section, behind the space that it begins with), or none."""
        split: list[list[str] | None] = []
        for text in texts:
            try:
                split.append(self.units.split(text.decode()) if text else None)
            except UnicodeDecodeError:
                split.append(None)
        wanted = {unit for units in split if units for unit in units}
        if len(self.known) > REMEMBERED:
            self.known.clear()
        fresh = list(wanted.difference(self.known))
        self.learn(fresh)
        done = []
        for units in split:
            found = [self.known[unit] for unit in units] if units else [None]
            done.append(None if None in found else tuple(
                np.frombuffer(b"".join(ids), dtype=np.int32) for ids in zip(*found)))
        for unit in fresh:
            if len(unit) > LONGEST:
                del self.known[unit]
        return done

    def align(self, found: list[tuple[np.ndarray, np.ndarray]], sizes: list[int]) -> Aligned:
        return Aligned([f[0] for f in found], [f[1] for f in found], np.array(sizes, dtype=np.int64),
                       self.a.vocabulary, self.b.vocabulary)

    def many(self, ids: list, texts: list[bytes], chunk: Chunk) -> pa.RecordBatch:
        """Texts of at most RUN bytes, worked on together."""
        found = self.tokens(texts)
        kept = [i for i, f in enumerate(found) if f is not None]
        done = self.align([found[i] for i in kept], [len(texts[i]) + 1 for i in kept])
        hashes = [""] * len(texts)
        for row, i in enumerate(kept):
            hashes[i] = hashlib.sha256(done.text[done.text_at[row]:done.text_at[row + 1] - 1]).hexdigest()
        counts = np.zeros((4, len(texts)), dtype=np.int64)
        counts[:, kept] = (done.n_a, done.n_b, done.n_groups, done.n_links)
        return self.rows(ids, np.array(kept, dtype=np.int64), done.pairs, counts, hashes, chunk)

    def long(self, doc_id: int | None, parts: list[bytes], chunk: Chunk) -> pa.RecordBatch:
        """One text, worked on section by section: no group reaches across a cut."""
        counts, pairs, digest = np.zeros((4, 1), dtype=np.int64), None, hashlib.sha256()
        for place, part in enumerate(parts):
            found = self.tokens([part[1:]])[0]
            if found is None:
                return self.many([doc_id], [b""], chunk)
            done = self.align([found], [len(part)])
            counts += np.array([done.n_a, done.n_b, done.n_groups, done.n_links])
            pairs = done.pairs if pairs is None else _counted(
                pa.concat_tables([pairs, done.pairs]), ["doc", "pair"], "n")
            last = place == len(parts) - 1
            digest.update(done.text[:done.text_at[1] - (1 if last else 0)])
        return self.rows([doc_id], np.zeros(1, dtype=np.int64), pairs, counts, [digest.hexdigest()], chunk)

    def rows(self, ids, kept, pairs: pa.Table, counts, hashes, chunk: Chunk) -> pa.RecordBatch:
        codes = chunk.add(pairs)
        doc, times = kept[pairs["doc"].to_numpy()], pairs["n"].to_numpy()
        order = np.lexsort((codes, doc))
        edge = pa.array(np.searchsorted(doc[order], np.arange(len(ids) + 1)), pa.int32())
        names = ("n_a", "n_b", "n_groups", "n_links")
        return _batch({
            "chunk": np.full(len(ids), chunk.name), "doc_id": ids, "groups_sha256": hashes,
            "codes": pa.ListArray.from_arrays(edge, pa.array(codes[order], pa.int32())),
            "times": pa.ListArray.from_arrays(edge, pa.array(times[order], pa.int64())),
            **dict(zip(names, counts))}, len(ids))


_ALIGNERS: list[tuple[int, Aligner]] = []


def _aligner(a_source: str, b_source: bytes) -> Aligner:
    name = hash((a_source, b_source))
    if not _ALIGNERS or _ALIGNERS[0][0] != name:
        _ALIGNERS[:] = [(name, Aligner(a_source, b_source))]
    return _ALIGNERS[0][1]


def _align(a_source: str, b_source: bytes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = _aligner(a_source, b_source)
        partition = TaskContext.get().partitionId()
        serial, chunk = 0, Chunk(partition << 32)

        def groups(batch: pa.RecordBatch) -> Iterator[tuple[list, list[bytes]]]:
            ids, texts, size = [], [], 0
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.large_binary())):
                text = text.as_py() or b""
                if ids and size + len(text) > RUN:
                    yield ids, texts
                    ids, texts, size = [], [], 0
                ids.append(doc_id)
                texts.append(text)
                size += len(text)
            if ids:
                yield ids, texts

        for batch in batches:
            for ids, texts in groups(batch):
                parts = sections(texts[0], aligner.b.divisible) if len(texts) == 1 and texts[0] else []
                yield aligner.long(ids[0], parts, chunk) if len(parts) > 1 else aligner.many(ids, texts, chunk)
                if chunk.full():
                    yield from chunk.rows()
                    serial += 1
                    chunk = Chunk((partition << 32) + serial)
        yield from chunk.rows()

    return run


def _score(documents: pa.Table, answers: pa.Table) -> pa.Table:
    """A chunk's documents with the sums of what the answers say of their pairs."""
    size = documents.num_rows
    count = np.zeros(answers.num_rows, dtype=np.int64)
    top = np.zeros(answers.num_rows, dtype=bool)
    code = answers["code"].to_numpy()
    count[code], top[code] = answers["count"].to_numpy(), answers["top"].to_numpy()
    lists = documents["codes"].combine_chunks()
    of = pc.list_parent_indices(lists).to_numpy()
    codes = pc.list_flatten(lists).to_numpy()
    times = pc.list_flatten(documents["times"].combine_chunks()).to_numpy()
    sums = np.zeros((2, size), dtype=np.int64)
    np.add.at(sums[0], of, times * top[codes])
    np.add.at(sums[1], of, times * count[codes])
    return pa.table({
        **{c: documents[c] for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links")},
        "n_best": sums[0], "count_sum": sums[1], "groups_sha256": documents["groups_sha256"]})


def align(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """Per document the alignment of its tokens by both tokenizers, and the corpus-wide weight of its links.

    ``a_path`` is the JSON file of a byte-level BPE, ``b_path`` a sentencepiece model.
    """
    run = _align(Path(a_path).read_text(encoding="utf-8"), Path(b_path).read_bytes())
    aligned = saved(without(docs, "doc_id", "text").mapInArrow(run, ALIGNED))
    pairs = aligned.where("first IS NOT NULL").select(
        F.col("chunk").alias("of"), "first", F.posexplode(F.arrays_zip("a", "b", "n")).alias("place", "pair"),
    ).select("of", (F.col("first") + F.col("place")).alias("code"), "pair.*")
    counts = saved(pairs.groupBy("a", "b").agg(F.sum("n").alias("count")))
    # One row for each identifier of the first vocabulary: bounded by the tokenizer.
    highest = counts.groupBy("a").agg(F.max("count").alias("highest"))
    known = counts.join(F.broadcast(highest), "a").select(
        "a", "b", "count", (F.col("count") == F.col("highest")).alias("top"))
    answers = lookup_join(pairs.drop("n"), known, ["a", "b"], "inner").select("of", "code", "count", "top")
    documents = aligned.where("first IS NULL").drop("first", "a", "b", "n")
    return documents.groupBy("chunk").cogroup(answers.groupBy("of")).applyInArrow(_score, RESULT)
