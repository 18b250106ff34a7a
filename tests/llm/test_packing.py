import random
import zlib
from collections import defaultdict

import numpy as np
from public_tokenizers import path
from tokenizers import Tokenizer

from gristmill.llm import packing

WORD_BPE = path("word_bpe_49k.json")


def brute(rows, limit):
    tokenizer = Tokenizer.from_file(WORD_BPE)
    for doc_id, text in rows:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 1]
        for piece, at in enumerate(range(0, len(ids), limit)):
            part = np.array(ids[at:at + limit], dtype="<u4").tobytes()
            yield doc_id, piece, at, len(part) // 4, zlib.crc32(part)


def check_gapless(rows, limit):
    found = defaultdict(list)
    for r in rows:
        found[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in found.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= limit
    return len(found)


def test_pack(odd_docs, odd_rows):
    for limit in (4096, 50):
        rows = packing.pack(odd_docs, WORD_BPE, limit).collect()
        key = lambda r: (r[0] is None, r[0] or 0, *r[1:])
        assert sorted([tuple(r)[:5] for r in rows], key=key) == sorted(brute(odd_rows, limit), key=key)
        total = sum(r["length"] for r in rows)
        assert check_gapless(rows, limit) <= -(-total // limit) + 1


def test_empty(no_docs):
    assert packing.pack(no_docs, WORD_BPE).collect() == []


def test_plan_covers_every_piece_and_dominates():
    rng = random.Random(2)
    for limit in (10, 64, 500):
        for _ in range(60):
            counts = {s: rng.randint(1, 40) for s in rng.sample(range(1, limit + 1), rng.randint(1, limit // 2))}
            patterns = packing.plan(counts, limit)
            used = defaultdict(int)
            for times, content in patterns:
                assert sum(s * k for s, k in content) <= limit and times > 0
                for s, k in content:
                    used[s] += times * k
            assert used == counts


def smallest(sizes, limit):
    """The least number of sequences, by trying every placement."""
    best = [len(sizes)]

    def place(i, rooms):
        if len(rooms) >= best[0]:
            return
        if i == len(sizes):
            best[0] = len(rooms)
            return
        for r in {*rooms}:
            if r >= sizes[i]:
                rest = list(rooms)
                rest.remove(r)
                place(i + 1, [*rest, r - sizes[i]])
        place(i + 1, [*rooms, limit - sizes[i]])

    place(0, [])
    return best[0]


def test_fixed_sets_never_cost_a_sequence():
    rng = random.Random(5)
    for _ in range(150):
        sizes = sorted((rng.randint(1, 20) for _ in range(rng.randint(1, 8))), reverse=True)
        counts = {s: sizes.count(s) for s in sizes}
        fixed, rest = packing.reduce_by_dominance(counts, 20)
        left = [s for s, n in sorted(rest.items(), reverse=True) for _ in range(n)]
        assert sum(t for t, _ in fixed) + (smallest(left, 20) if left else 0) == smallest(sizes, 20)
