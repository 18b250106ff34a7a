"""Token alignment against a plain loop over tokens, groups and occurrence pairs."""

import hashlib
from collections import Counter, defaultdict
from itertools import accumulate

import public_tokenizers
import pytest

from gristmill.llm import alignment

A_PATH = public_tokenizers.path("byte_bpe_50k.json")
B_PATH = public_tokenizers.path("piece_bpe_32k.model")
ODD = [
    " ", "  two  blanks  ", "\ttab\nline \n next", " ends here ", "▁ marks ▁of▁ pieces", "a b c　d e",
    "日本語のテキスト 漢字", "🙂 emoji🙂🙂 flag 🇩🇪", "<|endoftext|> and <s> </s> <0x41> <unk>", "=" * 333 + " " + "-" * 77,
    "x\x00y \x1c z\x85w", "don't we'll I'm  it's", "ﬁ ligature ① é é", "1234567890 3.14159 1,000", " " * 300, "\n" * 90,
]


def tokenizers():
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(A_PATH)
    a.encode_special_tokens = True
    b = SentencePieceProcessor(model_file=B_PATH)
    letters = alignment.byte_letters()

    def a_bytes(i):
        return bytes(letters[c] for c in a.id_to_token(i))

    def b_bytes(i):
        piece = b.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if b.is_byte(i) else piece.replace("▁", " ").encode()

    return (lambda t: a.encode(" " + t, add_special_tokens=False).ids), a_bytes, b.encode, b_bytes


def plain(rows):
    a_encode, a_bytes, b_encode, b_bytes = tokenizers()
    held, docs = Counter(), []
    for doc_id, text in rows:
        groups, links, a, b = [], Counter(), [], []
        if text:
            a, b = a_encode(text), b_encode(text)
            whole = (" " + text).encode()
            if b"".join(map(a_bytes, a)) != whole or b"".join(map(b_bytes, b)) != whole:
                a, b = [], []
        a_ends = list(accumulate(len(a_bytes(i)) for i in a))
        b_ends = list(accumulate(len(b_bytes(i)) for i in b))
        i = j = 0
        for end in sorted(set(a_ends) & set(b_ends)):
            group = [], []
            while i < len(a) and a_ends[i] <= end:
                group[0].append(a[i])
                i += 1
            while j < len(b) and b_ends[j] <= end:
                group[1].append(b[j])
                j += 1
            groups.append(group)
            links.update((x, y) for x in group[0] for y in group[1])
        held.update(links.keys())
        written = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        docs.append((doc_id, len(a), len(b), groups, links, hashlib.sha256(written.encode()).hexdigest() if a else ""))
    best = defaultdict(int)
    for (x, _), n in held.items():
        best[x] = max(best[x], n)
    return [(d, n_a, n_b, len(groups), links.total(), sum(n for p, n in links.items() if held[p] == best[p[0]]),
             sum(n * held[p] for p, n in links.items()), written) for d, n_a, n_b, groups, links, written in docs]


def in_order(rows):
    return sorted((tuple(r) for r in rows), key=lambda r: (r[0] is None, r))


def test_odd_texts(spark, odd_rows, odd_docs):
    extra = [(1000 + i, t) for i, t in enumerate(ODD)]
    docs = odd_docs.select("doc_id", "text", "size", "bucket").unionByName(
        spark.createDataFrame(extra, "doc_id long, text string"), allowMissingColumns=True)
    docs = docs.withColumn("chunk", docs.bucket).withColumn("code", docs.bucket)
    got = alignment.align(docs, A_PATH, B_PATH)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert in_order(got.collect()) == in_order(plain(odd_rows + extra))


def test_empty_table(no_docs):
    assert alignment.align(no_docs, A_PATH, B_PATH).collect() == []


def test_query_on_whole_documents(spark, small):
    from gristmill.llm.queries import REGISTRY

    rows = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()
    assert in_order(REGISTRY["op12_token_alignment"](spark, small).collect()) == in_order(plain(rows))


@pytest.fixture
def tight(monkeypatch):
    """Bounds so small that texts are cut, chunks close early and joins are sliced."""
    for name, value in (("RUN", 300), ("CHUNK_PAIRS", 500), ("CHUNK_LINKS", 900), ("SLICE", 40),
                        ("REMEMBERED", 200), ("LONGEST", 4)):
        monkeypatch.setattr(alignment, name, value)
    monkeypatch.setattr(alignment, "_ALIGNERS", [])


def test_bounds_change_nothing(spark, odd_rows, tight):
    from pyspark import cloudpickle

    # The module travels by value, so its changed bounds reach the workers too.
    assert cloudpickle.dumps(alignment._align)
    rows = [(i, (t or "") + " then " + (t or "") if i % 2 else t) for i, t in enumerate(
        [t for _, t in odd_rows] + [t * 20 for t in ODD])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert in_order(alignment.align(docs, A_PATH, B_PATH).collect()) == in_order(plain(rows))


def test_sections_give_the_text_back(tight):
    text = b"some words here " * 60
    parts = alignment.sections(text, True)
    assert len(parts) > 2 and b"".join(parts) == b" " + text
    assert all(p[:1] == b" " for p in parts)


def test_bytes_that_are_no_utf8(spark):
    docs = spark.sql("SELECT 1L AS doc_id, CAST(X'61FF62' AS STRING) AS text UNION ALL SELECT 2L, 'fine text'")
    got = {r.doc_id: r for r in alignment.align(docs, A_PATH, B_PATH).collect()}
    assert (got[1].n_a, got[1].n_links, got[1].groups_sha256) == (0, 0, "")
    assert got[2].n_a > 0
