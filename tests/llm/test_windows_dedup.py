import hashlib
import re

from gristmill.llm import windows_dedup

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def brute(rows, width):
    first, split = {}, []
    for doc_id, text in rows:
        words = WORD.findall((text or "").encode())
        key = -1 if doc_id is None else doc_id
        split.append((doc_id, key, words))
        for i in range(len(words) - width + 1):
            window = tuple(words[i:i + width])
            first[window] = min(first.get(window, (key, i)), (key, i))
    for doc_id, key, words in split:
        gone = set()
        for i in range(len(words) - width + 1):
            if first[tuple(words[i:i + width])] < (key, i):
                gone.update(range(i, i + width))
        kept = b" ".join(w for i, w in enumerate(words) if i not in gone)
        yield doc_id, len(words), len(gone), hashlib.sha256(kept).hexdigest()


def order(r):
    return (r[0] is None, r[0] or 0, *r[1:])


def test_report(odd_docs, odd_rows):
    rows = [tuple(r) for r in windows_dedup.dedup_report(odd_docs, 20).collect()]
    want = sorted(brute(odd_rows, 20), key=order)
    assert sorted(rows, key=order) == want
    assert sum(w[2] for w in want) > 500


def test_whole_documents(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    found = sorted(tuple(r) for r in windows_dedup.dedup_report(docs.repartition(6), 20).collect())
    assert found == sorted(brute(rows, 20))


def test_empty(no_docs):
    assert windows_dedup.dedup_report(no_docs).collect() == []


def test_remove_keeps_columns(odd_docs, odd_rows):
    cut = windows_dedup.remove_repeats(odd_docs, 20)
    assert cut.columns == odd_docs.columns
    want = {r[0]: r for r in brute(odd_rows, 20)}
    for r in cut.collect():
        _, words, removed, digest = want[r["doc_id"]]
        if removed:
            assert hashlib.sha256((r["text"] or "").encode()).hexdigest() == digest
        else:
            assert r["text"] in [t for i, t in odd_rows if i == r["doc_id"]]


def test_many_rows_without_identifier(spark):
    """Texts are told apart by 64 bits: among so many, 32 bits would give some text another one's spans."""
    docs = spark.range(120_000).selectExpr(
        "CAST(NULL AS LONG) AS doc_id",
        "concat_ws(' ', transform(sequence(0, CAST(id % 50 AS INT)), k -> concat('w', id, '_', k)), "
        "array_join(transform(sequence(1, 20), k -> concat('same', k)), ' ')) AS text")
    rows = windows_dedup.dedup_report(docs).groupBy("n_removed").count().collect()
    # Without identifiers the window that starts first in its text is the first one, 2400 times.
    assert sorted(map(tuple, rows)) == [(0, 2_400), (20, 117_600)]
