"""Combining, linking, filling, splitting and loading on hand-made rows."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from gristmill.functions.frames import lookup_join
from gristmill.operators import combine, facets, fill, fuzzy, profiling, search, split
from gristmill.operators.link import Comparison
from gristmill.plans import flows
from gristmill.sources import catalogue, tables


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def comparison(spark, **options):
    left = spark.createDataFrame(
        [("Maize", "H614"), ("Maize", "H614"), ("Beans", None)], "CROP string, `VARIETY RELEASE NAME` string")
    right = spark.createDataFrame(
        [("maize", "h614"), ("Maize", "H615")], "CROP string, `VARIETY RELEASE NAME` string")
    return flows.compare(left, right, **options)


def test_compare(spark):
    found = comparison(spark)
    assert found.matches().count() == 2
    assert rows(found.unique_left()) == [("BEANS", "")]
    assert rows(found.unique_right()) == [("MAIZE", "H615")]
    stats = found.stats().first()
    assert (stats.matches_found, stats.unique_to_file1, stats.unique_to_file2) == (2, 1, 1)
    assert (stats.match_rate_file1, stats.match_rate_file2) == (66.67, 100.0)
    assert rows(found.match_groups()) == [("MAIZE||H614", 2, 1, 2)]


def test_compare_partitions_the_left_side(spark):
    left = spark.range(300).select(
        (F.col("id") % 3).cast("string").alias("c"),
        F.when(F.col("id") % 7 != 0, F.concat(F.lit("n & "), F.col("id") % 50)).alias("v"))
    right = spark.range(40).select(F.lit("1").alias("c"), F.concat(F.lit("N  "), "id").alias("v"))
    found = Comparison(left, right, ("c", "v"), ("c", "v"))
    matched = found.match_groups().agg(F.sum("n_left")).first()[0]
    assert matched + found.unique_left().count() == 300
    stats = found.stats().first()
    assert stats.matches_found == found.matches().count()
    assert stats.unique_to_file2 == found.unique_right().count()


def test_unnamed_rows_on_the_right(spark):
    left = spark.createDataFrame([("a", "x")], "c string, v string")
    right = spark.createDataFrame([("a", "x"), ("a", None), ("a", "&&")], "c string, v string")
    found = Comparison(left, right, ("c", "v"), ("c", "v"))
    assert found.unique_right().count() == 0
    assert found.including_blank().unique_right().count() == 2
    assert found.matches().count() == 1
    no_names = Comparison(left, right, ("c", None), ("c", "v"))
    assert no_names.matches().count() == 0 and no_names.unique_left().count() == 1


def test_hot_key_is_split_by_adaptive_execution(spark):
    changed = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20k",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20k",
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
    }
    before = {k: spark.conf.get(k, None) for k in changed}
    for k, v in changed.items():
        spark.conf.set(k, v)
    try:
        # one key holds most of the rows; the lookup side comes out of an aggregation
        left = spark.range(0, 200000, 1, 8).select(
            F.when(F.col("id") % 10 < 8, 7).otherwise(F.col("id")).alias("k"),
            F.sha2(F.col("id").cast("string"), 256).alias("x"))
        right = spark.range(200000).groupBy((F.col("id")).alias("k")).agg(F.count("*").alias("n"))
        for how in ("left", "left_anti"):
            joined = lookup_join(left, right, ["k"], how)
            joined.collect()
            assert "skew=true" in joined._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_dedup(spark):
    df = spark.createDataFrame(
        [("A", 1, None, None), ("A", 1, "x", "y"), (None, 2, None, None), (None, 2, "z", None)],
        "crop string, n int, p string, q string")
    kept = combine.dedup_most_complete(df, ["crop", "absent"], order=["n"])
    assert rows(kept) == [("A", 1, "x", "y"), (None, 2, "z", None)]
    stats = combine.duplicate_stats(df, ["crop"]).first()
    assert stats[:4] == (4, 2, 2, 1)
    assert combine.dedup_most_complete(df, ["absent"]).count() == 4
    assert combine.duplicate_stats(df, ["absent"]).first()[:4] == (4, 4, 0, 0)


def test_dedup_prunes_before_the_shuffle(spark):
    df = spark.range(100).select((F.col("id") % 3).alias("crop"), "id")
    plan = combine.dedup_most_complete(df, ["crop"], ["id"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2


def test_combine_keeps_every_row_once(spark):
    a = spark.createDataFrame(
        [("Maize", "H1"), (None, "H2"), ("x", " ")], "CROP string, `VARIETY RELEASE NAME` string")
    b = spark.createDataFrame([("Beans", "B 1", 3)], "`Crop kind` string, cultivar string, extra int")
    sources = [combine.Source("a", a), combine.Source("b", b)]
    done = flows.combine_and_deduplicate(sources)
    assert done.quarantine.count() == 2
    stats = {r.filename: r for r in done.source_stats.collect()}
    assert (stats["a"].valid_records, stats["a"].skipped_records) == (1, 2)
    assert (stats["b"].crop_column, stats["b"].variety_column) == ("Crop kind", "cultivar")
    assert done.records.columns == ["crop", "variety_release_name", "source_file", "source_index"]
    assert combine.parse_columns(" a, b ,,c") == ["a", "b", "c"]


MASTER = "crop string, variety_release_name string, country string, yield_mt_ha string, seed_type string, other_countries_of_release string"


def fill_one(spark, master, fields, row=("Maize", "H1"), **options):
    catalogue_df = spark.createDataFrame(master, MASTER)
    up = spark.createDataFrame([row], "c string, v string")
    return fill.match_and_fill(up, catalogue_df, fields, "c", "v", **options).first()


def test_fill_rules(spark):
    master = [
        ("Maize", "H1", "Kenya", "4", "b", "Kenya; Uganda"),
        ("maize", "h1", "Zambia", "5", "a", "Uganda|Malawi"),
        ("MAIZE", "H 1", "Nowhere", "99", "z", None),
        ("Maize", "H1", None, "4.5", "a", None),
    ]
    got = fill_one(spark, master, ["yield_mt_ha", "seed_type", "other_countries_of_release"], own_country="KENYA")
    assert (got.yield_mt_ha, got.seed_type) == ("5.0", "a")
    assert got.other_countries_of_release == "Malawi; Uganda; Zambia"
    assert (got.match_status, got.match_count, got.match_type) == ("success", 3, "crop_and_variety")


def test_fill_unreadable_numbers_and_ties(spark):
    master = [("M", "x", None, v, s, None) for v, s in [("1.2.3", "b"), ("7", "a"), ("7", None)]]
    got = fill_one(spark, master, ["yield_mt_ha", "seed_type"], ("m", "X"))
    assert (got.yield_mt_ha, got.seed_type) == ("7", "a")
    got = fill_one(spark, [("M", "x", None, "high", None, None)], ["yield_mt_ha"], ("m", "X"))
    assert got.yield_mt_ha == "high"


@pytest.mark.parametrize("row, status", [
    (("Beans", "H1"), "crop_mismatch"), (("Maize", "H9"), "no_match"), (("Maize", None), "empty_name"),
    ((None, "H1"), "success"), ((" ", "H9"), "variety_not_found"), (("Rice", "R1"), "no_fields_filled"),
])
def test_fill_statuses(spark, row, status):
    master = [("Maize", "H1", None, "4", None, None), ("Rice", "R1", None, None, None, None)]
    assert fill_one(spark, master, ["yield_mt_ha"], row).match_status == status


def test_split(spark, tmp_path):
    df = spark.createDataFrame(
        [("a/b", 1), ("ab", 2), (None, 3), ("ab", 4)], "g string, n int")
    assert rows(split.split_groups(df, "g", 2)) == [("ab", 2)]
    assert split.split_groups(df, "g").agg(F.sum("record_count")).first()[0] == 4
    names = [r.file_name for r in split.split_manifest(df, "g", "p").collect()]
    assert sorted(names) == ["p_Unknown", "p_ab", "p_ab_2"]
    split.write_split_with_summary(df, "g", str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out" / "groups"))
    assert back.count() == 4 and back.where("split_value = 'ab'").count() == 2
    assert spark.read.parquet(str(tmp_path / "out" / "summary")).count() == 3


def test_materialised_tables_can_be_removed(spark, tmp_path, monkeypatch):
    from pathlib import Path

    from gristmill.functions import frames

    monkeypatch.setattr(frames, "_shared_folder", lambda spark: str(tmp_path))
    kept = frames.materialised(spark.range(5))
    folder = Path(frames._own_folder(spark))
    assert kept.count() == 5 and len(list(folder.iterdir())) == 1 and tmp_path in folder.parents
    frames.remove_materialised(spark)
    frames.remove_materialised(spark)
    assert not folder.exists()


class Unset:
    """A session that names no folder."""

    def __init__(self, spark, master):
        self.conf, self.sparkContext = self, self
        self.applicationId, self.master = spark.sparkContext.applicationId, master

    def get(self, name, default):
        return default


def test_shared_folder_of_sessions_that_name_none(spark):
    from gristmill.functions import frames

    folder = frames._shared_folder(Unset(spark, "local[2]"))
    assert folder.startswith("file:///") and folder == frames._shared_folder(Unset(spark, "local[2]"))
    with pytest.raises(ValueError):
        frames._shared_folder(Unset(spark, "spark://host:7077"))


def test_row_numbers_of_text_files(spark, tmp_path):
    """Places of rows in CSV and JSON files, however the files are cut."""
    folder = tmp_path / "many"
    folder.mkdir()
    lines = [f"{i},{'x' * (i % 40)}" for i in range(3000)]
    lines.insert(100, "")  # a blank line is no row
    (folder / "a.csv").write_text("n,t\n" + "\n".join(lines) + "\n")
    (folder / "b.csv").write_text("n,t\n" + "\n".join(f"{5000 + i},y" for i in range(500)) + "\n")
    (tmp_path / "c.jsonl").write_text("".join(f'{{"n": {i}}}\n' for i in range(2000)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in (before, "7000b", "1000b"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            rows = tables.read_with_position(spark, str(folder), format="csv", schema="n int, t string")
            assert rows.columns == ["n", "t", "row_position"]
            got = {r.n: r.row_position for r in rows.collect()}
            assert got == {**{i: i for i in range(3000)}, **{5000 + i: i for i in range(500)}}
            rows = tables.read_with_position(spark, str(tmp_path / "c.jsonl"))
            assert all(r.n == r.row_position for r in rows.collect()) and rows.count() == 2000
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_failed_load_leaves_the_catalogue(spark, tmp_path):
    F = fuzzy.F
    up = spark.range(100).select(F.concat(F.lit("V"), "id").alias("v"), F.lit("Maize").alias("c"),
                                 F.lit("KE").alias("k"), F.lit("2001").alias("y"))
    mapping = {"v": "variety_release_name", "c": "crop", "k": "country", "y": "year_of_release"}
    path = str(tmp_path / "catalogue")
    with pytest.raises(FileNotFoundError):
        catalogue.read_catalogue(spark, path)
    first = catalogue.replace_catalogue(up, mapping, path)
    broken = up.repartition(4).withColumn("c", F.when(F.col("v") == "V77", F.raise_error(F.lit("lost"))).otherwise("Beans"))
    reader = catalogue.read_catalogue(spark, path)
    with pytest.raises(Exception, match="lost"):
        catalogue.replace_catalogue(broken, mapping, path)
    assert catalogue.current_version(spark, path) == first
    assert catalogue.read_catalogue(spark, path).count() == reader.count() == 100
    second = catalogue.replace_catalogue(up.limit(3), mapping, path)
    assert catalogue.read_catalogue(spark, path).count() == 3 and reader.count() == 100
    assert catalogue.read_catalogue(spark, path, first).count() == 100
    third = catalogue.replace_catalogue(up.limit(4), mapping, path)
    kept = sorted(p.name for p in (tmp_path / "catalogue").iterdir() if p.is_dir())
    assert kept == [second, third]


def test_pages_by_key(spark):
    F = fuzzy.F
    df = spark.range(1000, numPartitions=7).select((F.col("id") * 37 % 10).alias("a"), "id", F.lit("x").alias("t"))
    want = sorted((r.a, r.id) for r in df.collect())
    index = search.page_index(df, ["a", "id"], 64).cache()
    assert sorted(map(tuple, index.collect())) == [
        (i // 64 + 1, *want[i], min(64, 1000 - i)) for i in range(0, 1000, 64)]
    for number in (1, 2, 9, 16):
        page = search.page_of_index(df, index, ["a", "id"], number)
        assert [(r.a, r.id) for r in page.collect()] == want[(number - 1) * 64:number * 64]
    assert search.page_of_index(df, index, ["a", "id"], 17).collect() == []
    assert search.page_index(df.limit(0), ["a", "id"], 64).collect() == []
    seen, key = [], None
    while rows := search.search_after(df, ["a", "id"], key, 300).collect():
        seen += [(r.a, r.id) for r in rows]
        key = seen[-1]
    assert seen == want


def test_later_pages_read_a_range(spark, tmp_path):
    F = fuzzy.F
    path = str(tmp_path / "rows")
    spark.range(10_000).select("id", (F.col("id") % 7).alias("x")).write.parquet(path)
    df = spark.read.parquet(path)
    index = search.page_index(df, ["id"], 50).cache()
    page = search.page_of_index(df, index, ["id"], 150)
    assert [r.id for r in page.collect()] == list(range(7450, 7500))
    plan = page._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(id,7450)" in plan and "LessThan(id,7500)" in plan
    assert "TakeOrderedAndProject" in plan and "Exchange" not in plan


def test_stored_profile_counts_a_load_once(spark):
    F = fuzzy.F
    parts = [spark.range(i * 5000, i * 5000 + 8000).select("id", F.when(F.col("id") % 2 == 0, F.lit("a")).alias("x"))
             for i in range(3)]
    sketches = [profiling.profile_sketches(p, f"l{i}") for i, p in enumerate(parts)]
    sketches.append(sketches[0])
    rows = {r["column"]: r for r in profiling.stored_profile(
        sketches[0].unionByName(sketches[1]).unionByName(sketches[2]).unionByName(sketches[3])).collect()}
    assert (rows["id"].total_rows, rows["id"].non_null, rows["x"].non_null, rows["x"].unique_values) == (
        24_000, 24_000, 12_000, 1)
    assert abs(rows["id"].unique_values / 18_000 - 1) <= profiling.SKETCH_ERROR


def test_catalogue_round_trip(spark, tmp_path):
    up = spark.createDataFrame(
        [("H1", "Maize", "KE", "2001", "rust"), (None, None, "KE", "1", None), (None,) * 5],
        "v string, c string, k string, y string, s string")
    mapping = {"v": "variety_release_name", "c": "crop", "k": "country", "y": "year_of_release",
               "s": "special_attributes"}
    path = str(tmp_path / "catalogue")
    catalogue.replace_catalogue(up, mapping, path, with_traits=True)
    stored = catalogue.read_catalogue(spark, path)
    assert stored.count() == 1 and stored.first().disease_tolerant == "YES"
    assert tuple(catalogue.load_stats(up, mapping).first()) == (1, 2)
    with pytest.raises(ValueError):
        catalogue.replace_catalogue(up, {"v": "crop"}, path)
    log = str(tmp_path / "log")
    for day, accuracy in ((1, 90.0), (2, 0.0), (3, None), (4, 80.0)):
        catalogue.log_run(spark, log, f"f{day}", "master", day, accuracy, None, datetime(2024, 1, day))
    table = spark.read.parquet(log)
    assert [r.filename for r in catalogue.recent_runs(table, 2).collect()] == ["f4", "f3"]
    assert catalogue.average_accuracy(table).first()[0] == 85.0


def test_formats_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, "ä, b"), (2, None)], "a int, b string")
    for suffix in ("parquet", "csv", "json", "orc"):
        path = str(tmp_path / f"t.{suffix}")
        tables.write_table(df, path, tables.table_format(path), files=1)
        assert rows(tables.read_table(spark, path, schema="a int, b string")) == rows(df)
    placed = tables.read_with_position(spark, str(tmp_path / "t.parquet"))
    assert sorted(r.row_position for r in placed.collect()) == [0, 1]
    folder = tables.read_folder(spark, str(tmp_path / "t.csv"), "csv")
    assert folder.where(F.col("source_file").endswith(".csv")).count() == 2
    assert tables.is_supported("x.CSV") and not tables.is_supported("x.xlsx")
    with pytest.raises(ValueError):
        tables.table_format("x.pdf")
    with pytest.raises(ValueError):
        tables.read_table(spark, "x.xlsx")


def brute_force(names, queries):
    """Every query against every name that shares a gram with it, all in Python."""
    import math
    from collections import Counter

    from gristmill.functions.similarity import best_similarity

    def grams(text):
        out = Counter()
        for word in text.lower().split():
            word = f" {word} "
            out.update(word[i:i + n] for n in (2, 3, 4) for i in range(len(word) - n + 1))
        return out

    clean = [n.upper() for n in names]
    df = Counter()
    for n in clean:
        df.update(set(grams(n)))
    idf = {g: math.log((1 + len(clean)) / (1 + c)) + 1 for g, c in df.items()}

    def vector(text):
        v = {g: t * idf[g] for g, t in grams(text).items() if g in idf}
        size = math.sqrt(sum(w * w for w in v.values())) or 1
        return {g: w / size for g, w in v.items()}

    vectors = [vector(n) for n in clean]
    out = {}
    for q in queries:
        mine, short = vector(q), len(q) < 5
        best, best_score = None, -1
        for name, c, v in zip(names, clean, vectors):
            cosine = sum(w * v.get(g, 0) for g, w in mine.items())
            share = .4 if short else .6
            score = share * cosine + (1 - share) * best_similarity(q.upper(), c)
            if cosine > 0 and score > best_score + 1e-9:
                best, best_score = name, score
        out[q] = (best, round(best_score, 6)) if best else None
    return out


def test_fuzzy_match_agrees_with_brute_force(spark):
    import random

    rng = random.Random(11)
    parts = ["hybrid", "maize", "red", "h", "614", "614d", "kilima", "bean", "rose", "coco", "x1"]
    names = [" ".join(rng.choices(parts, k=rng.randint(1, 4))) for _ in range(120)]
    names = [n for n in names if len(n) >= 2] + ["red", "red"]
    def spoiled(name):
        at = rng.randrange(len(name))
        return (name[:at] + rng.choice(["", "q", " "]) + name[at + 1:]).strip()
    queries = sorted({spoiled(n) for n in names} | {"red", "H614", "zzzzz", "rod"})
    queries = [" ".join(q.split()).upper() for q in queries if len(q.strip()) >= 2]
    table = spark.createDataFrame(list(enumerate(names)), "i int, name string")
    index = fuzzy.fit_names(table, "name", "i")
    asked = spark.createDataFrame([(q,) for q in sorted(set(queries))], "q string")
    want = brute_force(names, sorted(set(queries)))
    assert {None} < {w and w[0] for w in want.values()} and min(w[1] for w in want.values() if w) < 0.6
    for threshold in (0.2, 0.7, 1.0):
        got = {r.q: r for r in fuzzy.fuzzy_match(asked, "q", index, threshold).collect()}
        assert got.keys() == want.keys()
        for q, r in got.items():
            assert (r.confidence_score and round(r.confidence_score, 6)) == (want[q] and want[q][1])
            assert r.is_match == bool(want[q] and want[q][1] >= threshold - 1e-6)
            assert r.matched_name == (want[q][0] if r.is_match else None)


def made_names(count, seed):
    import random

    rng = random.Random(seed)
    words = ["".join(rng.choice("aeiounrtslkm") for _ in range(rng.randint(2, 8))) for _ in range(400)]
    return [" ".join(rng.choices(words, k=rng.randint(3, 8))) for _ in range(count)]


def test_few_pairs_fetch_whole_vectors(spark):
    """The bound of the partial sums leaves hardly more pairs than those that count."""
    names = made_names(400, 3)
    table = spark.createDataFrame(list(enumerate(names)), "i int, name string")
    asked = spark.createDataFrame([(n[:-3] + n[-2:],) for n in names], "q string")
    index = fuzzy.fit_names(table, "name", "i")
    vectors = fuzzy._asked(asked, "q", index).withColumn("need", fuzzy.F.lit(0.5))
    final = fuzzy._pairs(index.vectors, vectors, 0.5).count()
    assert final >= 400
    assert fuzzy.candidates(index.vectors, vectors, 0.5).count() < 2 * final


def test_pairs_meet_in_memory(spark, monkeypatch):
    """No pair is shuffled to be counted, and none is lost between the parts of the tables."""
    names = made_names(300, 6) + ["ab", "ab ab"]
    table = spark.createDataFrame(list(enumerate(names)), "i int, name string")
    asked = spark.createDataFrame([(n[:-3] + n[-2:],) for n in names], "q string")
    index = fuzzy.fit_names(table, "name", "i")
    vectors = fuzzy._asked(asked, "q", index).withColumn("need", fuzzy.F.lit(0.2))
    plan = fuzzy.candidates(index.vectors, vectors, 0.2)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "Aggregate" not in plan
    ours, theirs = ({r.id: {t.gram: t.weight for t in r.unit} for r in t.collect()} for t in (index.vectors, vectors))
    cosines = {(q, n): sum(w * y.get(g, 0.0) for g, w in x.items()) for q, x in theirs.items() for n, y in ours.items()}
    want = {pair for pair, cosine in cosines.items() if cosine >= 0.2}
    monkeypatch.setattr(fuzzy, "PART_ROWS", 64)
    for common in (0, 5, 512):
        monkeypatch.setattr(fuzzy, "COMMON", common)
        got = {(r.query, r.candidate) for r in fuzzy.candidates(index.vectors, vectors, 0.2).collect()}
        assert want <= got and all(cosines[pair] >= 0.2 - 1e-4 for pair in got)


def test_characters_bound_the_similarity(spark):
    """No pair is lost by the bound, and most pairs need no subsequence at all."""
    from gristmill.functions.similarity import best_similarity

    F = fuzzy.F
    names = [n.upper() for n in made_names(40, 4)] + ["AB", "B A", "AAAA", "A  B", "ÉA"]
    pairs = [(a, b) for a in names for b in names]
    df = spark.createDataFrame(pairs, "query string, candidate string").withColumn("cosine", F.lit(0.1))
    asked = spark.createDataFrame([(n, 0.4) for n in names], "clean string, best double")
    rows = fuzzy.bounded(df, spark.createDataFrame([(n,) for n in names], "clean string"), asked).collect()
    assert len(rows) == len(pairs)
    for r in rows:
        assert r.most >= r.share * 0.1 + (1 - r.share) * best_similarity(r.query, r.candidate) - 1e-9
    behind = [r for r in rows if r.most >= 0.4]
    assert 0 < len(behind) < 0.9 * len(rows)


def test_similarity_above_a_least_value_is_exact():
    import random

    from gristmill.functions.similarity import Masks, best_similarity, partial_ratio, ratio

    rng, masks = random.Random(8), Masks()
    for _ in range(400):
        a, b = ("".join(rng.choice("ab c") for _ in range(rng.randint(1, 12))) for _ in range(2))
        short, long = sorted((a, b), key=len)
        windows = [long[max(i, 0):i + len(short)] for i in range(1 - len(short), len(long))]
        plain = max(ratio(short, w) for w in windows)
        if len(a) == len(b):
            plain = max(plain, *(ratio(long, short[max(i, 0):i + len(long)]) for i in range(1 - len(long), len(short))))
        assert partial_ratio(a, b) == plain
        true, least = best_similarity(a, b), rng.random()
        found = best_similarity(a, b, least, masks)
        assert found == true if true > least + 1e-12 else found <= max(least, true) + 1e-12


def test_fuzzy_edges(spark, tmp_path):
    table = spark.createDataFrame([(0, "Maize H614"), (1, None), (2, "a")], "i int, name string")
    index = fuzzy.fit_names(table, "name", "i")
    index.write(str(tmp_path / "index"))
    stored = fuzzy.NameIndex.read(spark, str(tmp_path / "index"))
    got = {r.input: r for r in fuzzy.match_names(spark, ["maize h614", "a", "beans"], stored).collect()}
    assert got["maize h614"].is_match and got["maize h614"].confidence_score == pytest.approx(1)
    assert got["a"].confidence_score == 0.0 and not got["a"].is_match
    assert got["beans"].matched_name is None and got["beans"].confidence_score is None
    stats = fuzzy.fuzzy_stats(fuzzy.match_names(spark, ["maize h614", "beans"], stored)).first()
    assert tuple(stats) == (2, 1, 50.0, 1.0)
    low = fuzzy.fuzzy_match(table, "name", index, 0.1).collect()
    assert [(r.i, r.matched_name, r.is_match) for r in sorted(low)] == [
        (0, "Maize H614", True), (1, None, False), (2, None, False)]


def test_search_literal_and_levels(spark):
    df = spark.createDataFrame(
        [(1, "a_b", "Maize", "KE"), (2, "axb", "Beans", "maize land")],
        "id int, variety_release_name string, crop string, country string")
    ids = lambda d: sorted(r.id for r in d.collect())
    assert ids(search.search(df, "A_B")) == [1]
    assert ids(search.search(df, "a_b", wildcards=True)) == [1, 2]
    assert ids(search.search(df, "maize")) == [1]
    assert ids(search.search(df, "maize", mode="global")) == [1, 2]
    assert ids(search.search(df, "nothing")) == []
    assert ids(search.search(df, "", {"crop": "bean"})) == [2]
    assert search.suggest(df, "a", "crop").count() == 0
    assert search.suggest(df, "ai", "id").count() == 0
    info = search.page_info(df, 2, 50).first()
    assert (info.total, info.pages, info.start_item, info.end_item) == (2, 1, 51, 2)


def test_profiles_on_nan_and_empty(spark):
    df = spark.createDataFrame([(float("nan"), " "), (1.0, "x")], "a double, b string")
    quality = profiling.cell_quality(df).first()
    assert (quality.filled_fields, quality.total_fields, quality.completion_rate) == (2, 4, 50.0)
    empty = df.where("false")
    assert profiling.cell_quality(empty).first().completion_rate == 0.0
    assert facets.facet_counts(df, {"b": ["x"]}).first().total_matching == 1
    exact = {r.column: r.unique_values for r in profiling.column_profile(df).collect()}
    rough = {r.column: r.unique_values for r in profiling.approximate_profile(df).collect()}
    assert exact == rough == {"a": 1, "b": 2}


def test_fill_names_counts_and_numbers(spark):
    """Names of punctuation are no names; numbers keep Python's form; only what is asked for is summed up."""
    catalogue = spark.createDataFrame(
        [("maize", "%%", "9"), ("maize", "H1\n", "0.0005"), ("maize", "h1", "0.0001"), ("beans", "B1", "10000000000000000"),
         ("rice", "R1", "7")], "crop string, variety_release_name string, yield_mt_ha string")
    rows = spark.createDataFrame(
        [(1, "Maize", "&&"), (2, "maize", "H1"), (3, None, "b1"), (4, "maize", "B1"), (5, "x", "y"), (6, "x", None)],
        "row int, crop string, name string")
    filled = fill.match_and_fill(rows, catalogue, ["yield_mt_ha"], "crop", "name")
    found = {r["row"]: (r["yield_mt_ha"], r["match_status"], r["match_count"]) for r in filled.collect()}
    assert found == {
        1: ("", "empty_name", 0), 2: ("0.0005", "success", 2), 3: ("1e+16", "success", 1),
        4: ("", "crop_mismatch", 0), 5: ("", "no_match", 0), 6: ("", "empty_name", 0)}
    plan = filled._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("LeftSemi") == 1 and plan.index("Generate inline") < plan.index("LeftSemi")


def test_fill_sums_up_rows_not_cells(spark, monkeypatch):
    """A catalogue row is one row up to its sum, unless its name is frequent; the results are the same."""
    catalogue = spark.createDataFrame(
        [(c, n, k, y, s, o) for i, (c, n) in enumerate([("m", "a b"), ("m", "A  B"), ("b", "a b"), ("m", "z")] * 3)
         for k, y, s, o in [("KE" if i % 2 else "UG", ["7", "1.2.3", "high", None][i % 4], "ts"[i % 2], ["X; Y|KE", " ; ", None][i % 3])]],
        MASTER)
    rows = spark.createDataFrame([("m", "A B"), (None, "a b"), ("b", "a b"), ("x", "a b"), ("m", "z"), (None, "%")], "c string, v string")
    fields = ["yield_mt_ha", "seed_type", "other_countries_of_release"]

    def filled():
        return fill.match_and_fill(rows, catalogue, fields, "c", "v", own_country="ke")

    plan = filled()._jdf.queryExecution().optimizedPlan().toString()
    assert "mode(" in plan and "generate explode(split" not in plan.lower()
    got = sorted(map(str, filled().collect()))
    assert "other_countries_of_release='UG; X; Y', match_status='success', match_type='crop_and_variety', match_count=6" in str(got)
    monkeypatch.setattr(fill, "OFTEN", 2)
    assert sorted(map(str, filled().collect())) == got


def test_facets_have_no_cap(spark):
    df = spark.range(250).select((F.col("id") % 150).cast("string").alias("v"))
    assert facets.facet_table(df).count() == 150
    assert facets.facet_table(df, limit=20).count() == 20
    view = facets.facet_view(df, mapping={}, limit=20).first()
    assert len(view["facet_values"]) == 20 and view["total_values"] == 150 and view["total_records"] == 250
