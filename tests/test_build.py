"""What has no SQL: buckets, banded links, listings, the staged build; and repeated batches of the stream."""

import hashlib
import os
import random
import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from quillspark.functions import registry, text
from quillspark.operators import curate, dedup, set_join, splits
from quillspark.operators.cuts import new_path, work_dir
from quillspark.plans import build, curation, library, stages
from quillspark.plans.curation import master_rows
from quillspark.sources import files
from quillspark.streaming import results

SF = "/root/testdata/sf0.001"
needs_tables = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def test_bucket(spark):
    got = {r.id: r.b for r in spark.createDataFrame([("a",), ("প",), ("17",)], "id string").select("id", splits.bucket("id", "s").alias("b")).collect()}
    assert got == {i: int(hashlib.blake2b(f"s:{i}".encode(), digest_size=8).hexdigest(), 16) / 2**64 for i in ("a", "প", "17")}


@needs_tables
def test_banded_links_are_true_and_most_are_found(spark):
    keys = library.keyed(spark, SF).groupBy("key").agg(F.min("doc_id").alias("id"))
    sets = dedup.shingled(keys, "id", "key").cache()
    exact = {(r.a, r.b) for r in dedup.similar_pairs(sets, threshold=0.9).collect()}
    found = {(r.a, r.b) for r in dedup.banded_links(sets).collect()}
    assert found <= exact and len(found) >= 0.98 * len(exact)
    left, right = sets.where("id % 2 = 0"), sets.where("id % 2 = 1")
    across = [(r.a, r.b) for r in dedup.cross_banded_pairs(left, right).collect()]
    assert len(across) == len(set(across)) and {(a, b) for a, b in exact if a % 2 != b % 2} <= {(min(p), max(p)) for p in across}


@needs_tables
def test_publish_plan(spark):
    got = {r.path: r.bytes for r in build.publish_plan(spark, SF).collect()}
    assert got == {n: os.path.getsize(f"{SF}/{n}") for n in ("documents.parquet", "labels.parquet")}


def test_torn_line(spark, tmp_path):
    (tmp_path / "log.jsonl").write_text('{"a": 1}\n{"a": 2}\n{"a": ')
    got = files.json_lines(spark, str(tmp_path / "log.jsonl"), "a long")
    assert sorted(r.a for r in got.collect()) == [1, 2]


def test_stream_goes_on_where_it_stopped(spark, tmp_path):
    source, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))

    def put(*rows):
        log = spark.createDataFrame([("b", i, "ar", "3", "numeric", said, n) for i, said, n in rows], results.SCHEMA)
        files.write_json(log, source, "append")
        results.grade_stream(spark, source, out, state).awaitTermination()
        return {r.eval_id: r.correct for r in spark.read.parquet(out).collect()}, spark.read.parquet(out).count()

    assert put(("x", "#### 3", 1), ("x", "#### 4", 2)) == ({"x": True}, 1)
    assert put(("x", "#### 4", 3), ("y", None, 1)) == ({"x": True, "y": False}, 2)


def test_stream_has_no_task_of_python_for_each_key(spark, tmp_path):
    """The least seq counts, one without seq last, null keys are keys; a batch's first lines are aggregated by Spark itself."""
    log = spark.createDataFrame([("b", "x", "ar", "3", "numeric", "#### 3", 2), ("b", "x", "ar", "3", "numeric", "#### 4", None), ("b", "x", "ar", "3", "numeric", "#### 5", 5), ("b", None, "ar", "3", "numeric", "#### 3", None)], results.SCHEMA)
    assert {(r.eval_id, r.output) for r in results.first_lines(log).collect()} == {("x", "#### 3"), (None, "#### 3")}
    source, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    for _ in range(2):
        files.write_json(log, source, "append")
        results.grade_stream(spark, source, out, state).awaitTermination()
    assert sorted(map(str, (r.eval_id for r in spark.read.parquet(out).collect()))) == ["None", "x"]


def test_only_texts_that_composition_may_change_go_to_python(spark):
    said = ["e\u0301 x", "caf\u00e9", "\u09a1\u09bc", "\u212b", "\u02ff", "plain", "", None, "a\u0300", "\u1100\u1161", "x \u0340"]
    registry.register(spark)
    rows = spark.createDataFrame([(s,) for s in said], "s string")
    got = [tuple(r) for r in rows.select("s", text.composed("s"), text.matching_key("s"), F.expr("matching_key(s)")).collect()]
    assert all(c == (s and unicodedata.normalize("NFC", s)) for s, c, _, _ in got) and all(k == m for _, _, k, m in got)
    assert not re.search(text.COMPOSABLE.replace("x{0}", "x00").replace("x{2FF}", "u02ff"), "caf\u00e9 \u02ff plain\n")
    assert all(unicodedata.normalize("NFC", a + b) == a + b for a in "aAe\u00e9\u02ff" for b in map(chr, range(0x300)))


@needs_tables
def test_staged_build(spark):
    master = master_rows(spark, SF)
    evals = stages.evals_from(master.where("id % 13 = 0").select(F.lit("held").alias("benchmark"), F.lit(0).alias("ord"), F.col("question_bn").alias("question")))
    lineage = spark.createDataFrame([], "source string, derived_key string, parent_key string, parent_benchmark string")
    loaded = spark.createDataFrame([("held",)], "benchmark string")
    out = new_path(spark, "build")
    got = stages.build(spark, master, evals, lineage, loaded, out, dropped_sources=("bad",))
    n = {r.stage: r.n for r in stages.counts(got).collect()}
    assert got["unified"].count() == master.count() and n["splits"] == n["verified"] <= n["deduped"] <= n["unified"]
    keys = stages.matching_key("question_bn")
    assert got["deduped"].select("key").distinct().count() == n["deduped"]
    assert got["verified"].select(keys.alias("key")).join(evals, "key", "left_semi").isEmpty()
    again = stages.build(spark, master, evals, lineage, loaded, out, start=4)
    assert {r.stage: r.n for r in stages.counts(again).collect()} == n


def _written(spark):
    root = work_dir(spark).removeprefix("file://")
    return sum(os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(root) for f in names)


@needs_tables
@pytest.mark.parametrize("query", [library.near_pairs, library.near_components, build.whole_dedup, curation.decontaminate_near, curation.decontaminate_reasons])
def test_near_joins_write_little_more_than_the_texts(spark, query):
    """What a join of shingles leaves in the shared folder: keys and links, not every shingle."""
    before = _written(spark)
    assert query(spark, SF).count()
    assert _written(spark) - before < 2 * library.read(spark, SF, "documents").selectExpr("sum(octet_length(text))").first()[0]


@pytest.mark.parametrize("threshold", [0.4, 0.8])
def test_similar_sets_of_all_sizes(spark, monkeypatch, threshold):
    """All pairs by brute force, of sets that lie on both sides of the classes' bounds, in many parts and packed runs."""
    monkeypatch.setattr(set_join, "PART", 500)
    monkeypatch.setattr(set_join, "HELD", 3000)
    rng = random.Random(3)
    own = {}
    for g, n in enumerate((1, 2, 5, 40, 230, 255, 256, 300, 511, 512, 600, 1023, 1024, 2100)):
        base = [rng.getrandbits(62) for _ in range(n)]
        for k in range(6):
            kept = [x for x in base if rng.random() > 0.04 * k]
            own[g * 10 + k] = {*kept, *(rng.randrange(400) for _ in range(n * k // 40 + (not kept)))}
    sets = spark.createDataFrame([(i, sorted(s)) for i, s in own.items()], "id long, grams array<long>")
    want = {(a, b): len(own[a] & own[b]) / len(own[a] | own[b]) for a in own for b in own if a < b}
    want = {p: j for p, j in want.items() if j >= threshold - 1e-12}
    got = [(r.a, r.b, r.jaccard) for r in dedup.similar_pairs(sets, threshold=threshold).collect()]
    assert len(got) == len(want) > 50 and {(a, b): j for a, b, j in got} == want
    across = {(r.a, r.b) for r in dedup.similar_pairs(sets.where("id % 2 = 0"), sets.where("id % 2 = 1"), threshold).collect()}
    assert across == {p if p[0] % 2 == 0 else p[::-1] for p in want if sum(p) % 2}


def _components(pairs):
    root = {}
    for a, b in pairs:
        x, y = root.setdefault(a, a), root.setdefault(b, b)
        root.update({k: min(x, y) for k, r in root.items() if r in (x, y)})
    return root


@pytest.mark.parametrize("threshold", [0.5, 0.8])
@pytest.mark.parametrize("bound", [(2048, 4_000_000), (7, 4_000_000), (2048, 900)])
def test_links_connect_what_all_pairs_connect(spark, monkeypatch, threshold, bound):
    """Chains, copies, unlike neighbours and sizes across the classes, in one block of a group or in many."""
    for name, value in zip(("PART", "HELD", "STEP", "MEMBERS", "BLOCK"), (500, 3000, 50, *bound), strict=True):
        monkeypatch.setattr(set_join, name, value)
    rng = random.Random(5)
    own = {}
    for g, n in enumerate((1, 2, 5, 40, 150, 255, 300, 600)):
        base = [rng.getrandbits(62) for _ in range(n)]
        for k in range(40):
            if k % 4 == 0 and k:
                base = [x if rng.random() > 0.13 else rng.getrandbits(62) for x in base]  # a chain of copies of copies
            own[f"{g}-{k}"] = {*(x for x in base if rng.random() > 0.01 * (k % 4)), rng.randrange(300)}
    rows = spark.createDataFrame([(i, sorted(s)) for i, s in own.items()], "id string, load array<long>")
    want = [(a, b) for a in own for b in own if a < b and len(own[a] & own[b]) / len(own[a] | own[b]) >= threshold - 1e-12]
    links = [tuple(sorted(r)) for r in set_join.linked(rows, set_join.array_grams, threshold).collect()]
    assert set(links) <= set(want) and _components(links) == _components(want) and len(set(_components(want).values())) > 5
    assert set_join.linked(rows.limit(0), set_join.array_grams, threshold).count() == 0


def test_groups_of_near_copies_write_no_pairs(spark):
    """Of many near copies neither the pairs nor their texts for each pair are written; all are one component."""
    letters = "abcdefghijklmnopqrstuvwxyz"
    rng = random.Random(1)
    text = "".join(rng.choice(letters) for _ in range(400))
    keys = spark.createDataFrame([(i, text[:i] + "0" + text[i + 1 :]) for i in range(400)], "id long, key string")
    counts = []

    def counted(df, name, real=set_join.cut):
        out = real(df, name)
        counts.append((name, out.count()))
        return out

    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(set_join, "cut", counted)
        got = dedup.near_clusters(keys, 0.9).collect()
    assert {(r.node, r.root) for r in got} == {(i, 0) for i in range(400)}
    assert max(n for _, n in counts) < 24 * 400, counts


def test_dedup_writes_no_solutions(spark, monkeypatch):
    """Whole rows come back, null pools and repeated ids too, but no solution is written on the way."""
    columns = []
    monkeypatch.setattr(dedup, "cut", lambda df, name, real=dedup.cut: columns.extend(df.columns) or real(df, name))
    key = "abcdefghij" * 9
    given = [("1", key, "rl", True, "long", "1", []), ("2", key, "sft", True, "s", None, []), ("3", key[1:], "rl", True, "x", "0", []), ("4", "other", None, True, None, None, ["f"]), ("5", "", "rl", False, "y", None, []), ("5", "apart", "rl", True, "yy", None, [])]
    rows = spark.createDataFrame(given, "id string, key string, pool string, verifiable boolean, solution string, vote_key string, flags array<string>")
    got = {r.id: (r.key, r.solution, r.verifiable, r.flags) for r in dedup.dedup(rows).collect()}
    assert got == {"2": (key, "s", True, []), "4": ("other", None, True, ["f"]), "5": ("apart", "yy", True, [])}
    assert "solution" not in columns and columns


@needs_tables
def test_banded_links_of_texts(spark):
    """One row of hashes a set is written, not one for each band; keys give the links that their shingles give."""
    keys = library.keyed(spark, SF).groupBy("key").agg(F.min("doc_id").alias("id"))
    sets = dedup.shingled(keys, "id", "key").cache()
    assert dedup._bands(sets, 128, 16).count() == sets.count()
    links = [sorted((r.a, r.b, r.jaccard) for r in df.collect()) for df in (dedup.banded_links(sets), dedup.banded_text_links(keys))]
    assert links[0] == links[1] != []


def test_banded_links_beside_a_smaller_unlike_id(spark):
    """Links between members of a bucket are found although its smallest id is unlike all of them."""
    rows = []
    for g in range(30):
        base = [g * 1000 + i for i in range(100)]
        rows.append((g * 10, base[:60]))  # similar to the others by 0.6 only
        rows += [(g * 10 + k, [*base, -g * 1000 - k]) for k in range(1, 6)]
    sets = spark.createDataFrame(rows, "id long, grams array<long>")
    low = {r.id: r.sig[0] for r in dedup.signatures(sets, 1).collect()}
    own = {i: set(g) for i, g in rows}
    want = {(a, b) for a in own for b in own if a < b and low[a] == low[b] and len(own[a] & own[b]) >= 0.9 * len(own[a] | own[b])}
    got = [(r.a, r.b) for r in dedup.banded_links(sets, permutations=1, bands=1).collect()]
    assert len(want) > 100 and set(got) == want and len(got) == len(want)


def test_json_arrays(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a\n\"b", None), (2, None, [1, 2]), (3, "প", [])], "id int, t string, n array<int>")
    for i, df in enumerate((rows.repartition(2), rows.limit(0))):
        files.write_json_array(df, f"{tmp_path}/{i}")
        assert sorted(map(repr, files.json_array(spark, f"{tmp_path}/{i}", rows.schema).collect())) == sorted(map(repr, df.collect()))


def test_manifest_and_gaps(spark, tmp_path):
    for name in ("one/b.csv", "one/a.csv", "two/c.json", "stray.txt"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text("x")
    known = spark.createDataFrame([("one", "primary"), ("two", "secondary"), ("three", "primary"), ("four", "secondary")], "name string, role string")
    rows = files.manifest(spark, known, str(tmp_path))
    assert {r.name: r.downloaded for r in rows.collect()} == {"one": ["a.csv", "b.csv"], "two": ["c.json"], "three": [], "four": []}
    assert [(r.benchmark, r.problem) for r in files.gaps(rows).collect()] == [("three", "not downloaded")]
    assert files.gaps(files.manifest(spark, known, f"{tmp_path}/absent")).count() == 2


def test_benchmark_is_filtered_sampled_and_limited(spark):
    rows = spark.range(300).selectExpr("concat('e', lpad(id, 3, '0')) AS eval_id", "id % 3 != 0 AS verifiable", "id % 5 != 0 AS variants_differ", "CAST(id % 4 AS STRING) AS stratum")
    got = files.load_benchmark(rows, limit=30, sample=40).collect()
    assert len(got) == 30 and all(r.verifiable and r.variants_differ for r in got) and [r.eval_id for r in got] == sorted(r.eval_id for r in got)
    assert files.load_benchmark(rows).count() == 160 and files.load_benchmark(rows, gradable=False).count() == 300 and files.load_benchmark(rows, sample=1000).count() == 160


def test_eval_records(spark):
    rows = spark.createDataFrame([(0, "১ + 1?", " 2 ", "k", None), (1, "  ", "2", "k", "x"), (2, "q", None, "", "x"), (3, "no digits", "(B) 5", "k", "")], "i int, q string, a string, kind string, meta string")
    got = {r.eval_id: r for r in curate.eval_records(rows, "bench", F.col("i"), "q", "a", ("kind", "meta")).collect()}
    assert (got["bench_0"].question_ar_digits, got["bench_0"].question_bn_digits, got["bench_0"].gold_answer, got["bench_0"].verifiable, got["bench_0"].meta) == ("1 + 1?", "১ + ১?", "2", True, {"kind": "k"})
    assert [got[f"bench_{i}"].skip_reason for i in range(4)] == [None, "empty_question", "empty_answer", None] and not got["bench_3"].variants_differ
    report = {(r.measure, r.name): r.n for r in curate.eval_report(curate.eval_records(rows, "bench", F.col("i"), "q", "a")).collect()}
    assert report == {("records", "problems"): 2, ("records", "variants_differ"): 1, ("records", "verifiable"): 2, ("records", "usable_for_agreement"): 1, ("answer_type", "numeric"): 1, ("answer_type", "mcq_option"): 1, ("original_script", "mixed"): 1, ("original_script", "no_digits"): 1, ("skipped", "empty_question"): 1, ("skipped", "empty_answer"): 1}
