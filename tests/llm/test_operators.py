"""Each operator against brute force or the library, with nulls, repeats, empty tables and extra columns."""

import hashlib

import duckdb
import numpy as np
import pandas as pd
import pyarrow.parquet as pq
import pytest
import xxhash

from quillspark.llm import ann, embedding_dedup, license_scan, license_texts, mixing, sentencepiece_codec, shingle_dedup, simhash, substring_dedup, toxicity, url_filter, warc

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, source string, fp string, h long, words string, key long"
LONG = " ".join(f"w{i % 997}" for i in range(30_000))
PASSAGE = " ".join(f"shared{i}" for i in range(40))


def odd_docs(spark):
    texts = [None, "", "  ", "one", "one two", "a b c d e f g", "a b c d e f g", LONG, LONG + " tail", f"x {PASSAGE} y", f"{PASSAGE}\nz", f"q {PASSAGE}", "All rights\nreserved. CC BY and cc by", "émigré Ünder 漢字 ▁ x\x00y"]
    return spark.createDataFrame([(i, t, "s1" if i % 3 else None, "fp", 1, "w", 2) for i, t in enumerate(texts)], DOCS)


def empty_docs(spark):
    return spark.createDataFrame([], DOCS)


def fingerprint(text):
    w = (text or "").encode().lower().split()
    h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 3]), 42) for i in range(max(1, len(w) - 2))] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def test_simhash(spark):
    rows = {r.doc_id: r for r in simhash.near_duplicates(odd_docs(spark)).collect()}
    fps = {r.doc_id: fingerprint(r.text) for r in odd_docs(spark).collect()}
    assert {i: r.fp & (2**64 - 1) for i, r in rows.items()} == fps
    for i, r in rows.items():
        reach, todo = {i}, [i]
        while todo:
            a = todo.pop()
            for b in fps:
                if b not in reach and (fps[a] ^ fps[b]).bit_count() <= 3:
                    reach.add(b)
                    todo.append(b)
        assert r.component_id == min(reach)
    assert simhash.near_duplicates(empty_docs(spark)).count() == 0


@pytest.mark.parametrize("flips", [1, 2, 3, 4])
def test_ball_hashing(flips):
    rng = np.random.default_rng(flips)
    for _ in range(60):
        a = rng.integers(0, 1 << 63, dtype=np.uint64)
        b = a
        for bit in rng.permutation(64)[:flips].tolist():
            b ^= np.uint64(1) << np.uint64(bit)
        u, _ = simhash.links_in_bucket(0, np.array([a, b], np.uint64), 0)
        assert len(u) == (flips <= 3)


@pytest.mark.parametrize("top", [3, 6, 10])
def test_ball_hashing_by_prefixes(top):
    """Variants that travel by their top bits meet as those that don't."""
    rng, spread = np.random.default_rng(top), simhash._spread(top)
    fps = rng.integers(0, 1 << 63, 150, dtype=np.uint64)
    for flips in (1, 2, 3):
        other = fps.copy()
        for i in range(len(fps)):
            for bit in rng.permutation(64)[:flips].tolist():
                other[i] ^= np.uint64(1) << np.uint64(bit)
        both = pd.concat(spread([pd.DataFrame({"fp": np.concatenate([fps, other]).view(np.int64)})]))
        met = set()
        for bucket, part in both.groupby("bucket"):
            u, v = simhash.links_in_bucket(int(bucket), part["fp"].to_numpy().view(np.uint64), top)
            met.update(zip(u.tolist(), v.tolist(), strict=True))
        pairs = zip(fps.view(np.int64).tolist(), other.view(np.int64).tolist(), strict=True)
        assert all((max(a, b), min(a, b)) in met for a, b in pairs)


def test_one_of_each_by_row(spark):
    """A unique text stays though its doc_id repeats; copies go though theirs does, or is null."""
    rows = [(1, "x y z"), (1, "x y z"), (2, "x y z"), (3, "only this text"), (3, "x y z"), (None, "x y z"), (None, "another one"), (None, "another one"), (None, None)]
    docs = spark.createDataFrame([(*r, i, "c") for i, r in enumerate(rows)], "doc_id long, text string, row_key int, component string")
    for keep in (simhash.keep_first, shingle_dedup.keep_first):
        out = keep(docs)
        assert out.columns == docs.columns
        assert sorted(((r.doc_id, r.text) for r in out.collect()), key=repr) == sorted([(1, "x y z"), (3, "only this text"), (None, "another one"), (None, None)], key=repr)
        assert keep(docs.limit(0)).count() == 0


def test_sentencepiece(spark):
    import sentencepiece

    path = sentencepiece_codec.default_model()
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    docs = odd_docs(spark)
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    for r in sentencepiece_codec.round_trip(docs, path).collect():
        ids = sp.encode(texts[r.doc_id])
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256((sp.decode(ids) if ids else "").encode()).hexdigest()
    with open(path, "rb") as f:
        codec = sentencepiece_codec.Codec(f.read())
    rng = np.random.default_rng(0)
    odd = ["".join(rng.choice(list("abcthe  ▁\n\té漢😀,.-<s>0"), n)) for n in rng.integers(1, 40, 2000)]
    assert [x.tolist() for x in codec.encode(odd)] == sp.encode(odd)
    assert sentencepiece_codec.round_trip(empty_docs(spark), path).count() == 0


def test_substrings(spark):
    docs = odd_docs(spark)
    want = substring_dedup.brute_force([(r.doc_id, r.text) for r in docs.collect()])
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup.digests(docs).collect()}
    assert got == want and sum(v[1] for v in want.values()) > 30_000
    assert substring_dedup.digests(empty_docs(spark)).count() == 0
    kept = {r.doc_id: r.text for r in substring_dedup.strip_repeats(docs).collect()}
    assert kept[10] == "z" and kept[11] == "q" and kept[0] is None
    named = docs.selectExpr("*", "doc_id AS dk", "'t' AS th", "array(1) AS spans")
    out = substring_dedup.strip_repeats(named)
    assert out.columns == named.columns and {(r.dk, r.th, tuple(r.spans)) for r in out.collect()} == {(r.doc_id, "t", (1,)) for r in docs.collect()}
    runs = {(r.doc_id, r.start, r.n_words) for r in substring_dedup.passages(docs).collect()}
    assert {(10, 0, 40), (11, 1, 40)} <= runs
    nameless = spark.createDataFrame([(None, PASSAGE), (None, f"a {PASSAGE}"), (5, f"b {PASSAGE}"), (5, f"{PASSAGE} c"), (6, None)], "doc_id long, text string")
    got = sorted(((r.doc_id, r.n_words, r.n_removed) for r in substring_dedup.digests(nameless).collect()), key=repr)
    assert got == sorted([(None, 40, 40), (None, 41, 40), (5, 41, 0), (5, 41, 0), (6, 0, 0)], key=repr)


def test_subtree():
    """Deep internal nodes are the right-maximal repeats of several documents."""
    base = " ".join(f"w{i}" for i in range(15))
    texts = [f"{base} x y", f"{base} x z", base, "v " * 20, "v " * 20]
    tree = substring_dedup.Subtree([t.encode() for t in texts], np.array([1, 1, 1, 2, 1]), np.array([5, 3, 4, 9, 9]))
    assert tree.repeats().tolist() == [True, False, True, False, False, False]
    assert list(tree.internal_nodes()) == [(15, [0, 1, 2]), (16, [0, 1])]


def test_licences(spark):
    """All columns against a block by block count, whole texts at several offsets among them."""
    texts = [t for _, t in license_texts.TEXTS] + [t for _, t in license_texts.NOTICES]
    rows = [(100 + 10 * i + j, "pad " * 37 * j + t + " end") for i, t in enumerate(texts) for j in range(3)]
    rows += [(900 + i, " ".join(texts[0].split()[: 20 * i])) for i in range(10)] + [(None, "CC BY"), (None, None), (5, "İ CC BY"), (5, "İ CC BY")]
    docs = odd_docs(spark).select("doc_id", "text").unionByName(spark.createDataFrame(rows, "doc_id long, text string"))
    plain = lambda r: (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels, r.score)
    got = sorted(map(repr, ((r.doc_id, *plain(r)) for r in license_scan.scan_licenses(docs).collect())))
    assert got == sorted(map(repr, ((r.doc_id, *license_scan.brute_force(r.text)) for r in docs.collect())))
    found = {x.split("', ")[-2].strip("'") for x in got}
    assert {"mit", "zlib", "isc"} <= found
    assert license_scan.scan_licenses(empty_docs(spark)).count() == 0


def test_toxicity(spark):
    docs = spark.createDataFrame([(i, f"clean words number {i} " + ("vile" if i % 4 == 0 else "fine")) for i in range(200)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(200)] + [(9999, 1), (1, None)], "doc_id long, toxic int")
    lexicon = toxicity.learn(docs, toxicity.training(labels))
    m = toxicity.Matcher(lexicon)
    assert m.score("so V1LE!") >= 0.5 > m.score("so fine") == m.score(None) == m.score("") == 0 and m.score("vіle") >= 0.5
    assert toxicity.reject_toxic(docs, labels).count() == 150
    assert toxicity.score(docs, toxicity.learn(docs, labels.limit(0))).where("score > 0").count() == 0


def test_urls(spark):
    urls = [None, "no scheme", "http://a.example.org/es/1", "https://EXAMPLE.org/en/1?x", "http://org", "http://x.com/de/", "http://x.com/fr/#a", "ftp://notexample.org/es/", "http://h.net/"]
    pages = spark.createDataFrame([(i, u, "h") for i, u in enumerate(urls)], "page_id long, url string, host string")
    listed = spark.createDataFrame([("h.net",), ("absent",)], "key string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.judge(pages, listed).collect()}
    assert got[0] == got[1] == ("", "", None, "allow") and got[2] == ("a.example.org", "/es/1", "example.org/es/", "block")
    assert got[3] == ("example.org", "/en/1", "example.org/en/1", "block") and got[4] == ("org", "", None, "allow") and got[5][2:] == ("com/de/", "block")
    assert got[6][2:] == ("com/fr/", "allow") and got[7][2:] == ("org/", "allow") and got[8][2:] == (None, "block")
    assert url_filter.judge(pages.limit(0), listed).count() == 0 and url_filter.judge(pages, listed.limit(0)).where("verdict = 'block'").count() == 3
    assert url_filter.judge(pages, listed, {}).where("verdict = 'block'").count() == 1


@pytest.mark.parametrize("shards", [1, 7, 64])
def test_cascade(spark, shards):
    """Exact over the universe whatever the number of shards, with a key of a third of the rows, null and repeated keys."""
    keys = spark.range(30_000).selectExpr("CASE WHEN id % 3 = 0 THEN 'k77777' WHEN id = 1 THEN NULL ELSE concat('k', id) END AS key", "id AS l0")
    listed = keys.where("key like '%7'").select("key")
    cascade = url_filter.Cascade(listed, keys.select("key"), shards)
    marked = cascade.mark(keys, "key", "in")
    assert marked.columns == ["key", "l0", "in"] and marked.count() == 30_000
    assert marked.where("`in` != coalesce(key like '%7', false)").count() == 0 and len(cascade.levels) > 1


def test_warc(spark, tmp_path):
    big = "é" * 900
    pages = spark.createDataFrame([(1, "http://a/", big), (2, None, big), (3, "http://c\n/", big), (4, "u", "x"), (5, "u", "x"), (6, "u", None)], "page_id long, url string, html string")
    folder = f"file://{tmp_path}/warc"
    index = warc.write_archives(warc.typed(pages), folder)
    got = {r.page_id: (r.payload_bytes, r.record_type, r.refers_to, r.payload_digest) for r in warc.read_records(index, folder).collect()}
    sha = hashlib.sha1(big.encode()).hexdigest()
    assert got[1] == (1800, "revisit", 3, sha) and got[2] == (1800, "revisit", 3, sha) and got[3] == (1800, "response", None, sha)
    assert got[4][:3] == got[5][:3] == (1, "response", None) and got[6][0] == 0
    assert warc.read_records(index.where("page_id = 3"), folder).count() == 1
    again = spark.createDataFrame([(None, "u", big), (None, "u", big), (7, "u", big), (7, "u", big)], "page_id long, url string, html string")
    kinds = [(r.page_id, r.record_type, r.refers_to) for r in warc.typed(again).collect()]
    assert sorted(kinds, key=repr) == sorted([(None, "revisit", 7)] * 2 + [(7, "response", None)] * 2, key=repr)
    assert warc.read_records(warc.write_archives(warc.typed(pages.limit(0)), folder), folder).count() == 0


def test_mixing(spark):
    for w in ([1], [3, 5, 1], [7, 7, 2, 30]):
        used = [0] * len(w)
        for i, k, slot in mixing.schedule(w):
            assert used[i] == k
            used[i] += 1
            assert all(abs(u - x * (slot + 1) / sum(w)) < 1 for u, x in zip(used, w, strict=True))
    got = mixing.mix_order(odd_docs(spark), block_docs=2).collect()
    assert len(got) == odd_docs(spark).count() and len({(r.slot, r.position) for r in got}) == len(got)
    assert mixing.mix_order(empty_docs(spark)).count() == 0
    named = odd_docs(spark).selectExpr("*", "doc_id AS _s", "'x' AS _h", "7 AS slot", "doc_id AS part", "doc_id AS row", "'y' AS w")
    both = named.unionByName(named.where("doc_id < 3")).unionByName(named.limit(1).selectExpr("CAST(NULL AS LONG) AS doc_id", *named.columns[1:]))
    want = sorted(map(repr, (tuple(r) for r in both.collect())))
    assert mixing.mix(both).columns == both.columns and sorted(map(repr, (tuple(r) for r in mixing.mix(both).collect()))) == want
    at = mixing.placed(both)
    assert at.columns == [c for c in both.columns if c != "slot"] + ["slot", "position"] and at.count() == both.count()


def test_mixing_deviation(spark):
    """All documents once, each source in the order of its blocks, within one block of its weight at every slot until it ends."""
    docs = spark.range(4000).selectExpr("id AS doc_id", "CASE WHEN id % 10 < 7 THEN 'big' WHEN id % 10 < 9 THEN 'mid' END AS source", "concat('t', id) AS text")
    weights = {"big": 5, "mid": 3, None: 2}
    rows = mixing.mix_order(docs, weights, 4).orderBy("slot", "position").collect()
    assert sorted(r.doc_id for r in rows) == list(range(4000)) and len({(r.slot, r.position) for r in rows}) == 4000
    blocks = {}
    for r in rows:
        blocks.setdefault(r.slot, (r.source, r.block))
    used, left = dict.fromkeys(weights, 0), {s: -(-n // 4) for s, n in (("big", 2800), ("mid", 800), (None, 400))}
    for slot in range(max(blocks) + 1):
        if slot in blocks:
            source, block = blocks[slot]
            assert block == used[source]
            used[source] += 1
        if any(used[s] == left[s] for s in weights):
            break
        assert all(abs(used[s] - w * (slot + 1) / 10) < 1 for s, w in weights.items())
    assert slot > 200


def test_vectors(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(400, 16)).astype(np.float32)
    x[50:60] = x[7] + 0.05 * rng.normal(size=(10, 16))
    x[60:65] = x[8]
    data = [(i, v.tolist(), "n") for i, v in enumerate(x)] + [(1000, None, "n"), (1001, [0.0] * 16, "n"), (1002, [float("nan")] * 16, "n"), (1003, [1.0, None] * 8, "n"), (1004, [1.0], "n")]
    rows = spark.createDataFrame(data, "vec_id long, embedding array<float>, n string")
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1)[:, None]
    cos = u @ u.T
    np.fill_diagonal(cos, -2)
    got = {r.vec_id: r for r in embedding_dedup.link(rows).collect()}
    assert len(got) == 405 and [got[i].n_links for i in range(400)] == (cos >= 0.9).sum(1).tolist()
    assert got[59].component_id == min(7, *np.flatnonzero(cos[59] >= 0.9).tolist()) and got[1002].kept and got[1000].n_links == 0
    found = ann.search(rows, rows.where("vec_id % 50 = 0")).collect()
    mine = {(r.query_id, r.vec_id) for r in found}
    best = {(q, i) for q in range(0, 400, 50) for i in np.lexsort((np.arange(400), -cos[q]))[:5].tolist()}
    assert len(found) == 40 and len(mine & best) >= 36
    assert [r["rank"] for r in ann.search(rows, rows.where("vec_id = 8")).collect()] == [1, 2, 3, 4, 5]
    ties = [r.vec_id for r in ann.search(rows, rows.where("vec_id = 8")).orderBy("rank").collect()]
    assert ties == [60, 61, 62, 63, 64]
    odd = spark.createDataFrame([(9, [3.0, 0.0]), (9, [0.0, 1e200]), (10, [6.0, 0.0]), (None, [1.0, 0.0]), (11, [1e200, 1e190]), (12, []), (13, [1.0, 2.0, 3.0]), (14, [2.0, 4.0, 6.0])], "vec_id long, embedding array<double>")
    linked = sorted((r.vec_id or -1, r.n_links, r.component_id) for r in embedding_dedup.link(odd).collect())
    assert linked == [(-1, 3, 9), (9, 0, 9), (9, 3, 9), (10, 3, 9), (11, 3, 9), (12, 0, 12), (13, 1, 13), (14, 1, 13)]
    near = [(r.query_id, r["rank"], r.vec_id) for r in ann.search(odd, odd.where("vec_id in (10, 13)")).orderBy("query_id", "rank").collect()]
    assert near == [(10, 1, 9), (10, 2, 11), (10, 3, 9), (13, 1, 14)]
    tiny = ann.search(rows.where("vec_id in (0, 1, 2)"), rows.where("vec_id = 0")).collect()
    assert sorted(r["rank"] for r in tiny) == [1, 2]
    assert embedding_dedup.link(rows.limit(0)).count() == 0 and ann.search(rows.limit(0), rows.limit(0)).count() == 0


def test_neighbours_recall(spark):
    """Recall of at least 0.9 on vectors without structure, while the reranked share falls."""
    rng = np.random.default_rng(1)
    x = rng.normal(size=(6000, 48))
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    u = x / np.linalg.norm(x, axis=1)[:, None]
    asked = np.arange(0, 6000, 50)
    cos = u[asked] @ u.T
    cos[np.arange(len(asked)), asked] = -2
    best = {(int(q), int(i)) for q, row in zip(asked, np.argsort(-cos, axis=1)[:, :5], strict=True) for i in row}
    found = ann.search(rows, rows.where("vec_id % 50 = 0")).collect()
    assert len(found) == 5 * len(asked) and len(best & {(r.query_id, r.vec_id) for r in found}) >= 0.9 * len(best)
    assert all(abs(r.score - u[r.query_id] @ u[r.vec_id]) < 1e-12 for r in found)


@pytest.mark.parametrize("module", [url_filter, warc, embedding_dedup, license_scan, substring_dedup])
def test_sql(spark, module):
    got = module.query(spark, SF)
    db = duckdb.connect()
    for name in ("pages", "documents", "embeddings"):
        db.sql(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    want = db.sql(module.ORACLE)
    assert sorted(map(repr, (tuple(r[c] for c in want.columns) for r in got.collect()))) == sorted(map(repr, want.fetchall()))


def test_pipeline(spark):
    import corpus_pipeline

    out = corpus_pipeline.run(spark, SF)
    assert out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert 0 < out.count() <= pq.read_table(f"{SF}/documents.parquet").num_rows


def test_stages_on_odd_rows(spark, tmp_path):
    """Each stage but the last keeps the columns of its input, with nulls, repeats, clashing names and no rows."""
    import corpus_pipeline

    spark.createDataFrame([(1, 0)], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = odd_docs(spark).selectExpr("*", "doc_id AS _s", "'d' AS dk", "1 AS spans", "2 AS score", "3 AS component", "4 AS row_key")
    docs = docs.unionByName(docs.where("doc_id < 6")).unionByName(docs.where("doc_id > 8").selectExpr("CAST(NULL AS LONG) AS doc_id", *docs.columns[1:]))
    for rows in (docs, docs.limit(0)):
        for name, stage in corpus_pipeline.STAGES[:3]:
            out = stage(spark, rows, str(tmp_path))
            assert out.columns == rows.columns, name
            kept = {repr(r.asDict() | {"text": 0}) for r in rows.collect()}
            assert {repr(r.asDict() | {"text": 0}) for r in out.collect()} <= kept
        mixed = corpus_pipeline.mix_sources(spark, rows, str(tmp_path))
        assert mixed.columns == [*rows.columns, "slot", "position"] and mixed.count() == rows.count()
        assert corpus_pipeline.tokenize(spark, mixed, str(tmp_path)).count() == rows.count()


def test_toxicity_by_plain_search(spark):
    """The automaton's scores against searching each entry at each place."""
    lexicon = {" vile ": 2.0, " vil": 1.5, " idiot ": 1.7, " rotten": 0.9}
    texts = [None, "", "V1LE and vile", "villain, idiots; IDIOT", "idiot proof idiot", "rottenest r0tten", LONG, f"vile {LONG}", "vile " * 5000, "@$ v\u0456le"]

    def plain(text):
        t, total = toxicity.fold(text), 0.0
        spans = [(i, i + len(p)) for p in (f" {' '.join(toxicity.fold(x).split())} " for x in toxicity.EXCEPTIONS) for i in range(len(t)) if t.startswith(p, i)]
        for i, c in enumerate(t):
            best = max([w for e, w in lexicon.items() if t.startswith(e, i)], default=0) if c == " " else 0
            total += 0 if any(a <= i < b - 1 for a, b in spans) else best
        return 1 - np.exp(-total / (toxicity.SCALE * (1 + toxicity.LENGTH * np.log1p(len(t.split()) / 1000))))

    docs = spark.createDataFrame([(i if i else None, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id or 0: r.score for r in toxicity.score(docs, lexicon).collect()}
    assert all(abs(got[i] - plain(t)) < 1e-12 for i, t in enumerate(texts)) and got[2] > 0.5
    assert toxicity.score(docs.limit(0), lexicon).count() == 0 and toxicity.score(docs, {}).where("score > 0").count() == 0


def test_toxicity_evidence_ignores_copies(spark):
    """A word of many copies of one toxic text is no entry; one of many toxic texts is."""
    words = lambda i: " ".join(f"w{(i * 7919 + k * 104729) % 9973}x" for k in range(12))
    rows = [(i, f"{words(i)} vilest {words(i + 5000)}", 1) for i in range(40)]
    rows += [(100 + i, f"{words(77)} copied {words(78)}", 1) for i in range(40)]
    rows += [(1000 + i, words(i + 20000), 0) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    found = toxicity.learn(df, df.select("doc_id", "toxic"))
    assert " vilest " in found and " copied " not in found
    assert toxicity.learn(df, df.select("doc_id", "toxic").where("toxic = 0")) == {}


def test_toxicity_stems_dont_reach_clean_words(spark):
    """The stem of a toxic word goes where clean words share it, and stays where inflections are toxic too."""
    words = lambda i: " ".join(f"w{(i * 7919 + k * 104729) % 9973}x" for k in range(12))
    rows = [(i, f"{words(i)} {('grubber', 'snarking', 'snarked', 'snarks')[i % 4]} {words(i + 5000)}", 1) for i in range(160)]
    rows += [(1000 + i, words(i + 20000) + (" grubling" if i % 60 == 0 else ""), 0) for i in range(480)]
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    found = toxicity.learn(df, df.select("doc_id", "toxic"))
    assert " grubber " in found and " grubb" in found and " grub" not in found and " snar" in found
    m = toxicity.Matcher(found)
    assert m.score("a grubling") == 0 and m.score("snarkiest") >= 0.5 and m.score("gru8ber") >= 0.5


@pytest.mark.parametrize("least", [0, 1 << 40])
def test_substrings_of_hot_anchors(spark, monkeypatch, least):
    """The same rows whether every repeated anchor is hot or none is."""
    monkeypatch.setattr(substring_dedup, "LEAST_HOT", least)
    monkeypatch.setattr(substring_dedup, "HOT_SHARE", 1 << 40)
    line = "one very common line that is in nearly all of the texts here".split()
    rng = np.random.default_rng(5)
    rows = []
    for i in range(120):
        words = [f"w{k}" for k in rng.integers(0, 4, 40)]
        at = int(rng.integers(0, 30))
        rows.append((i, " ".join(words[:at] + line + (line if i % 3 == 0 else []) + words[at:])))
    rows += [(i, " ".join(["a", "b"] * i)) for i in (200, 220, 240)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup.digests(docs).collect()}
    assert got == substring_dedup.brute_force(rows)
    assert any(v[1] for v in got.values())


@pytest.mark.parametrize("rank", [2, 4, 64])
def test_links_across_lists_of_low_rank_groups(spark, monkeypatch, rank):
    """No link is lost where near copies differ along few directions and lie in many lists."""
    monkeypatch.setattr(embedding_dedup, "ROOT_SHARE", 0.5)  # 60 lists
    rng = np.random.default_rng(rank)
    x = rng.normal(size=(900, 64))
    x[:400] = x[0] + rng.normal(size=(400, rank)) @ rng.normal(size=(rank, 64)) * 0.45 / np.sqrt(rank)
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    u = x / np.linalg.norm(x, axis=1)[:, None]
    near = u @ u.T >= 0.9
    np.fill_diagonal(near, False)
    got = {r.vec_id: r.n_links for r in embedding_dedup.link(rows).collect()}
    assert near.sum() > 5_000 and [got[i] for i in range(900)] == near.sum(1).tolist()


def test_near_copies_of_the_pipeline(spark):
    """The pipeline's stage keeps one of each component that brute force finds at 0.8 by five words."""
    import corpus_pipeline

    rng = np.random.default_rng(3)
    texts = []
    for i in range(25):
        words = [f"w{x}" for x in rng.integers(0, 5000, 120)]
        for k in range(8):  # each change of a word costs up to five shingles
            own = list(words)
            for at in rng.integers(0, 120, k // 2 + (i % 2) * 2):
                own[at] = f"new{at}"
            texts.append(" ".join(own))
    texts += ["", " ", "one two", "One  two"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    w = [t.lower().split() for t in texts]
    sets = [{tuple(x[i : i + 5]) for i in range(max(1, len(x) - 4))} if x else {()} for x in w]
    root, links = list(range(len(sets))), []
    for a in range(len(sets)):
        for b in range(a):
            if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                links.append(len(sets[a] & sets[b]) / len(sets[a] | sets[b]))
                x, y = sorted((root[a], root[b]))
                root = [x if r == y else r for r in root]
    assert sum(j < 0.9 for j in links) > 50
    got = {r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, SF).collect()}
    assert got == set(root)


def test_pipeline_is_in_the_mixtures_order(spark, monkeypatch, tmp_path):
    """The result keeps each source within one block of its weight, however stored rows are dealt between stages."""
    import corpus_pipeline

    source = {i: "abc"[(i % 8 > 3) + (i % 8 > 6)] for i in range(800)}
    spark.createDataFrame([(i, f"text {i}", s) for i, s in source.items()], "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    dealt = ("dealt anew", lambda spark, docs, sf_dir: docs.repartition(5))
    monkeypatch.setattr(corpus_pipeline, "STAGES", [("source mixing", stages["source mixing"]), dealt, ("sentencepiece", stages["sentencepiece"])])
    out = [r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()]
    assert sorted(out) == sorted(source)
    left = {s: sum(x == s for x in source.values()) for s in "abc"}
    weights, block, used = mixing.default_weights(left), mixing.BLOCK_DOCS, dict.fromkeys(left, 0)
    for at, i in enumerate(out, 1):
        used[source[i]] += 1
        if used[source[i]] == left[source[i]]:
            break
        if at % block == 0:
            assert all(abs(used[s] / block - w * at / block / sum(weights.values())) < 1 for s, w in weights.items())
    assert at > 10 * block
