import glob
import hashlib
import math
import random
import zlib

import numpy as np
import pandas as pd
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from dossia.llm import exact_dedup, packing, queries, sharding, topk, url_graph
from dossia.llm.common import read, shared_dir

BYTES = public_tokenizers.path("byte_bpe_50k.json")


def lower(t):
    return "".join(c.lower() if c.isascii() else c for c in t or "")


# ---- exact dedup


def test_exact_dedup_matches_brute_force(spark):
    rng = random.Random(1)
    texts = ["Same", "same", "SAME", "É", "é", "", None, "x" * 300 + "a", "x" * 300 + "b", "X" * 300 + "A"] + [f"own {k}" for k in range(20)]
    rows = [(n, rng.choice(texts), "k") for n in range(200)] + [(5, "same", "k")] * 3 + [(None, "own 1", "k"), (None, "only null", "k"), (None, "only null", "k"), (500, "y" * 200_000, "k")]
    df = spark.createDataFrame(rows, "doc_id long, text string, keep_id string").repartition(4)
    got = exact_dedup.exact_dedup(df, digest="all").collect()
    groups = {}
    for i, t, _ in rows:
        groups.setdefault(lower(t), []).append(i)
    want = []
    for i, t, _ in rows:
        ids = [x for x in groups[lower(t)] if x is not None]
        keep = max(ids) if ids else None
        want.append((i, keep, len(groups[lower(t)]), hashlib.sha256(lower(t).encode()).hexdigest()))
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.digest) for r in got), key=repr) == sorted(want, key=repr)
    kept = [r for r in got if r.kept]
    assert sorted(r.digest for r in kept) == sorted({w[3] for w in want}) and all(r.doc_id == r.keep_id for r in kept)
    stays = exact_dedup.drop_exact_copies(df)
    assert stays.columns == df.columns
    assert sorted((lower(r.text), r.doc_id) for r in stays.collect() if r.doc_id is not None) == sorted((t, max(i for i in ids if i is not None)) for t, ids in groups.items() if any(i is not None for i in ids))
    assert stays.count() == len(groups) and exact_dedup.exact_dedup(df.limit(0)).count() == 0 == exact_dedup.drop_exact_copies(df.limit(0)).count()


def test_each_step_drops_rows(spark):
    """Of 60 rows 20 are alone in their length, 30 share it but no prefix, 10 share both and 4 of those are equal."""
    rows = [(n, "l" * (500 + n)) for n in range(20)] + [(100 + n, f"{n:03d}" + "m" * 200) for n in range(30)] + [(200 + n, "p" * 300 + (f"{n:03d}" if n > 3 else "999")) for n in range(10)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    texts = df.select(F.col("text").alias("_text"), F.octet_length("text").cast("long").alias("_len"))
    lengths = {r._len for r in exact_dedup.shared_lengths(texts).collect()}
    assert sum(len(t) in lengths for _, t in rows) == 40
    headed = exact_dedup._headed(texts, 1000)
    assert headed.where("_head is not null").count() == 40
    heads = exact_dedup.shared_heads(headed).collect()
    assert len(heads) == 1 and heads[0]._len == 303
    got = exact_dedup.exact_dedup(df).collect()
    assert sum(r.digest is not None for r in got) == 10 and sum(r.kept for r in got) == 57


def test_no_text_is_shuffled_whatever_the_number_of_keys(spark):
    """With broadcasts off or keys too many for them the results stay, and no exchange holds a text."""
    texts = ["same", "Same", "other", "", None] + [f"{n % 40:04d}" for n in range(200)]
    df = spark.createDataFrame([(n, t, "x") for n, t in enumerate(texts)] + [(0, "same", "x"), (3, "", "x")], "doc_id long, text string, _goes string").repartition(3)
    row = lambda r: (r.doc_id, r.keep_id, r.group_size, r.kept, r.digest)
    want = sorted(map(row, exact_dedup.exact_dedup(df, digest="all").collect()), key=repr)
    stays = sorted(map(repr, exact_dedup.drop_exact_copies(df).collect()))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = exact_dedup.exact_dedup(df, digest="all", few_keys=0)
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" in plan
        for line in plan.split("\n"):
            if "Exchange hashpartitioning" in line:
                assert "_text" not in line
        exchanged = plan.split("Exchange hashpartitioning")[1:]
        assert all("_text" not in part.split("\n")[1] or "Project" in part.split("\n")[1] for part in exchanged)
        assert sorted(map(row, got.collect()), key=repr) == want
        assert sorted(map(repr, exact_dedup.drop_exact_copies(df, few_keys=0).collect())) == stays
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


# ---- sharding


def test_shards(spark):
    rows = [(n % 37, "é" * (n % 5), "c") for n in range(500)] + [(1, None, "c")] * 200 + [(None, "", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, shard string").repartition(4)
    narrow = df.select("doc_id", sharding.record_size(F.col("text")).alias("size"))
    got = sharding.shard_rows(narrow, 7, bucket_rows=50).collect()
    assert sorted(((r.doc_id, r["size"]) for r in got), key=repr) == sorted(((i, 16 + len((t or "").encode())) for i, t, _ in rows), key=repr)
    sizes = [sorted(r.slot for r in got if r.shard == s) for s in range(7)]
    assert max(map(len, sizes)) - min(map(len, sizes)) <= 1 and all(s == list(range(len(s))) for s in sizes)
    assert sharding.shard_rows(narrow.limit(0), 7).count() == 0


def test_shuffle_moves_rows_and_writes(spark, tmp_path):
    df = spark.range(3000).withColumn("text", F.col("id").cast("string"))
    order = [r.id for r in sharding.shuffled_order(df, bucket_rows=100).orderBy("position").collect()]
    assert sorted(order) == list(range(3000))
    assert abs(np.corrcoef(order, range(3000))[0, 1]) < 0.1
    sharding.write_shards(df, str(tmp_path / "s"), 4, bucket_rows=500)
    back = spark.read.parquet(str(tmp_path / "s"))
    assert back.count() == 3000 and {r["count"] for r in back.groupBy("shard").count().collect()} == {750}


def test_positions_dont_depend_on_the_task_that_draws_them(spark):
    """A task that runs again after an executor is lost gets its rows in another order: positions stay."""
    df = spark.range(4000).withColumn("text", F.when(F.col("id") % 7 > 0, F.col("id").cast("string")))
    order = lambda d: [r.id for r in sharding.shuffled_order(d, bucket_rows=150).orderBy("position").collect()]
    first = order(df.repartition(3))
    assert first == order(df.repartition(11).orderBy(F.desc("id"))) and first != sorted(first)


def test_written_shards_of_odd_rows(spark, tmp_path):
    rows = [(1, None), (1, None), (None, ""), (2, "x" * 300_000), (3, "a"), (3, "a")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    sharding.write_shards(df.limit(0), str(tmp_path / "empty"), 4)
    sharding.write_shards(df, str(tmp_path / "odd"), 4)
    back = sharding.read_shards(spark, str(tmp_path / "odd"), df.schema)
    assert sorted(((r.doc_id, r.text) for r in back.collect()), key=repr) == sorted(rows, key=repr)
    assert sorted((r.shard, r.slot) for r in back.collect()) == [(0, 0), (0, 1), (1, 0), (1, 1), (2, 0), (3, 0)]


def test_long_records_make_more_buckets(spark):
    long = spark.range(600).withColumn("text", F.repeat(F.lit("x"), 100_000))  # 60 MB in 600 rows
    placed = sharding.shuffled_order(long).select("id", "bucket", "position").collect()
    assert sorted(r.position for r in placed) == sorted(r.id for r in placed) == list(range(600))
    in_bucket = np.bincount([r.bucket for r in placed])
    assert len(in_bucket) >= 4 and in_bucket.max() * 100_000 < 2 * sharding.BUCKET_BYTES


def test_query_writes_whole_documents(spark, sf_dir):
    before = set(glob.glob(f"{shared_dir(spark).removeprefix('file:')}/shards-*"))
    got = queries.op10_sharding(spark, sf_dir).collect()
    (path,) = set(glob.glob(f"{shared_dir(spark).removeprefix('file:')}/shards-*")) - before
    docs = read(spark, sf_dir, "documents")
    back = sharding.read_shards(spark, path, docs.schema)
    assert len(glob.glob(f"{path}/shard=*")) == 40
    assert back.select(docs.columns).exceptAll(docs).count() == 0 and back.count() == docs.count() == len(got)
    placed = {(r.doc_id, r.shard, r.slot) for r in back.select("doc_id", "shard", "slot").collect()}
    assert placed == {(r.doc_id, r.shard, r.slot) for r in got}


# ---- links between hosts

RULES = [url_graph.Rule(*r) for r in queries.RULES]


def ranks(edges, seeds, rounds, damping):
    total = sum(seeds.values())
    own = {h: n / total for h, n in seeds.items()}
    score = dict(own)
    out = {}
    for (a, _), n in edges.items():
        out[a] = out.get(a, 0) + n
    for _ in range(rounds):
        new = {h: x * (1 - damping) for h, x in own.items()}
        for (a, b), n in edges.items():
            if a in score:
                new[b] = new.get(b, 0) + damping * score[a] * n / out[a]
        score = new
    return score


def test_urls_match_brute_force(spark):
    rng = random.Random(6)
    hosts = ["good.example.net", "a.org", "b.org", "c.info", "d.info", "e.info", "BAD.net", "f.example.com"]
    pages = []
    for n in range(300):
        h = rng.choice(hosts)
        html = " ".join(f'<a HREF="{rng.choice(["http://", "//", "https://"])}{x}/p?q">' for x in rng.choices(hosts, k=rng.randint(0, 4))) + '<a href="/own">'
        pages.append((n, f"http://{h}{rng.choice(['/en/1', '/de/2', '/fr/3?x', '', '#t', '?a/en/'])}", html, "x"))
    pages += [(900, None, None, "x"), (901, "no scheme", "<a href='http://a.org'>", "x"), (901, "no scheme", None, "x"), (None, "ftp://Ünï.ORG/Fr/", "", None), (902, "http://net", "", "x"), (903, "x://sub.NET//", "", "x")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string, verdict string")
    got = url_graph.judge_urls(df, RULES)
    judged = {}
    low = lambda s: "".join(c.lower() if c.isascii() else c for c in s)
    rows, edges = [], {}
    for i, u, html, _ in pages:
        rest = u.split("://", 1)[1] if u and "://" in u else ""
        k = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        host, tail = low(rest[:k]), rest[k:]
        path = tail[: min([tail.find(c) for c in "?#" if c in tail], default=len(tail))]
        fits = [r for r in RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
        rows.append((i, host, path, max(fits, key=lambda r: len(r.text)) if fits else None))
        for part in (html or "").replace("'", '"').split('ref="')[1:] + (html or "").split('REF="')[1:]:
            link = part.split('"')[0]
            if "//" in link and host:
                to = low(link.split("//", 1)[1].split("/")[0])
                if to and to != host:
                    edges[host, to] = edges.get((host, to), 0) + 1
    count = lambda v: {h: sum(1 for _, x, _, r in rows if x == h and r and r.verdict == v) for h in {x for _, x, _, r in rows if r and r.verdict == v}}
    trust = ranks(edges, count("allow"), url_graph.ROUNDS, url_graph.DAMPING)
    against = {(b, a): n for (a, b), n in edges.items()}
    distrust = ranks(against, count("block"), url_graph.ROUNDS, url_graph.DAMPING)
    usual = ranks(against, {h: sum(1 for _, x, *_ in rows if x == h) for _, h, *_ in rows if h}, url_graph.ROUNDS, url_graph.DAMPING)
    for i, h, p, r in rows:
        bad = distrust.get(h, 0) > max(trust.get(h, 0), usual[h]) * (1 + 1e-9) if h else False
        judged.setdefault(i, []).append((h, p, r.text if r else None, r.verdict if r else "block" if bad else "allow"))
    for r in got.collect():
        assert (r.host, r.path, r["rule"], r.verdict) in judged[r.page_id], r
    assert got.count() == len(pages) and url_graph.judge_urls(df.limit(0), RULES).count() == 0
    import duckdb

    con = duckdb.connect()
    con.register("pages", df.toPandas())
    sql = con.execute(queries.ORACLES["op5_link_graph"]).fetchall()
    name = lambda i: None if i is None or i != i else int(i)
    assert sorted(((name(i), *rest) for i, *rest in sql), key=repr) == sorted(((r.page_id, r.host, r.path, r["rule"], r.verdict) for r in got.collect()), key=repr)
    assert any(v == "block" and rule is None for x in judged.values() for _, _, rule, v in x)


# ---- top-k


def test_topk_matches_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(5, 12))
    vectors = [(int(n), [float(x) for x in centres[n % 5] + rng.normal(size=12) * 0.2]) for n in range(400)]
    vectors += [(400 + n, vectors[7][1]) for n in range(60)]  # ties
    odd = [(600, None), (601, [1.0, None]), (602, [float("nan")] * 12), (603, [float("inf")] * 12), (604, [1.0, 2.0]), (700, [2.0, 1.0]), (800, []), (None, vectors[0][1]), (7, vectors[7][1])]
    df = spark.createDataFrame([(i, v, "x") for i, v in vectors + odd], "vec_id long, embedding array<double>, score string").repartition(3)
    usable = {i: [math.floor(1024 * x) for x in v] for i, v in vectors + odd if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)}
    want = set()
    for q in (i for i in usable if i % 100 == 0):
        scores = sorted((-sum(a * b for a, b in zip(usable[q], v, strict=True)), i) for i, v in usable.items() if i != q and len(v) == len(usable[q]))
        want |= {(q, n, i, -s) for n, (s, i) in enumerate(scores[:10], 1)}
    for block, slices in ((64, 4), (1000, 1)):
        got = topk.top_k(df, df.where("vec_id % 100 = 0"), 10, block_rows=block, slices=slices)
        assert {(r.query_id, r.rank, r.vec_id, r.score) for r in got.collect()} == want
    assert topk.top_k(df.limit(0), df.limit(0)).count() == 0


def test_only_collected_entries_are_resolved(monkeypatch):
    """The last phase adds up the partial scores of entries that reach the cutoff's share in some slice, and of no others."""
    rng = np.random.default_rng(4)
    q, c = rng.integers(-1000, 1000, (7, 16)).astype(float), rng.integers(-1000, 1000, (2000, 16)).astype(float)
    score = (q @ c.T).astype(np.int64)
    cuts = np.sort(score, axis=1)[:, -10]
    batch = pd.DataFrame({"q_block": [0], "q_ids": [list(range(-7, 0))], "c_ids": [list(range(2000))], "q_m": [q.ravel()], "c_m": [c.ravel()], "cut_ids": [list(range(-7, 0))], "cuts": [cuts.tolist()]})
    counted, before = [], topk._resolved
    monkeypatch.setattr(topk, "_resolved", lambda parts, i, at: (counted.append(len(at)), before(parts, i, at))[1])
    found = pd.concat(topk._scan(10, 4, resolve=True)([batch]))
    for n in range(7):
        want = sorted((-s, i) for i, s in enumerate(score[n].tolist()))[:10]
        assert [(-s, i) for i, s in zip(found[found.query_id == n - 7].vec_id, found[found.query_id == n - 7].score, strict=True)] == want
    assert 70 <= sum(counted) < 0.5 * score.size
    partial = [(q[:, 4 * k : 4 * k + 4] @ c[:, 4 * k : 4 * k + 4].T) * 4 >= cuts[:, None] for k in range(4)]
    assert counted == np.logical_or.reduce(partial).sum(axis=1).tolist()
    counted.clear()
    list(topk._scan(10, 4, resolve=False)([batch.drop(columns=["cut_ids", "cuts"])]))
    assert max(counted) <= 40  # four lists of ten


def test_topk_of_huge_components(spark):
    df = spark.createDataFrame([(0, [2.0**25, 1.0]), (1, [2.0**24, 3.0]), (2, [-(2.0**24), 1.0])], "vec_id long, embedding array<double>")
    got = {r.vec_id: r.score for r in topk.top_k(df, df.where("vec_id = 0")).collect()}
    assert got == {1: 2**63 - 1, 2: -(2**63 - 1)}  # beyond a long
    # Sums that fit a long are exact, also where a slice's part doesn't.
    df = spark.createDataFrame([(0, [2.0**22, 2.0**22, 1.0, 1.0]), (1, [2.0**20, 3.0, 5.0, 1.0]), (2, [2.0**24, -(2.0**24) + 2.0**18, 1.0, 0.0])], "vec_id long, embedding array<double>")
    got = {r.vec_id: r.score for r in topk.top_k(df, df.where("vec_id = 0")).collect()}
    assert got == {1: 2**62 + 3 * 2**42 + 6 * 2**20, 2: 2**60 + 2**20}


def test_links_elsewhere_and_forms_of_links(spark):
    """One link between unrelated hosts changes no verdict; unquoted attributes are links, data-href isn't."""
    pages = [(n, "http://shop.net/a" if n < 2 else f"http://h{n}.info/", "", "") for n in range(8)]
    verdicts = lambda rows: {r.page_id: r.verdict for r in url_graph.judge_urls(spark.createDataFrame(rows, "page_id long, url string, html string, x string"), RULES).collect()}
    rules = [url_graph.Rule("block", "bad.info", "/x")]
    judge = lambda rows: {r.page_id: r.verdict for r in url_graph.judge_urls(spark.createDataFrame(rows, "page_id long, url string, html string, x string"), rules).collect()}
    bad = [(20, "http://bad.info/x", "", ""), (21, "http://bad.info/y", "", "")]
    plain = judge(pages + bad)
    assert plain[21] == "block" and set(verdicts(pages).values()) <= {"allow", "block"}
    linked = judge([(n, u, "<a href='http://h3.info/'>" if n == 5 else h, x) for n, u, h, x in pages] + bad)
    assert linked == plain
    edges = url_graph.host_edges(spark.createDataFrame([("http://a/", "<a href=http://b/1>x<a data-href='http://c/'><A HREF = \"//d\" ><a class='x' href='//e/?q'>" + " y" * 200_000)], "url string, html string"))
    assert {r.dst for r in edges.collect()} == {"b", "d", "e"}


def test_two_seeds_and_a_link_elsewhere(spark):
    """bad1 has one blocked page, bad2 one of four pages, of ten in all. A link from another host to bad1 never reaches bad2, whose verdict stays."""
    rules = [url_graph.Rule("block", "bad1.info", "/x"), url_graph.Rule("block", "bad2.info", "/x")]
    pages = [(1, "http://bad1.info/x", ""), (2, "http://bad2.info/x", ""), *((n, "http://bad2.info/y", "") for n in (3, 4, 5)), *((n, f"http://h{n}.info/", "") for n in range(6, 11))]
    judge = lambda rows: {r.page_id: r.verdict for r in url_graph.judge_urls(spark.createDataFrame(rows, "page_id long, url string, html string"), rules).collect()}
    plain = judge(pages)
    assert plain[3] == "block" and plain[7] == "allow"
    linked = judge([(n, u, "<a href='http://bad1.info/'>" if n == 7 else h) for n, u, h in pages])
    assert linked == plain | {7: linked[7]} and linked[7] == "block"  # what links to a blocked host and nothing else is distrusted


def test_hubs_among_hosts(spark):
    """A host that half of all others link to, with distrust that flows back along all of those links."""
    pages = [(n, f"http://h{n}.info/", "<a href='http://hub.info/'>" if n % 2 else "") for n in range(400)] + [(1000, "http://hub.info/x", ""), (1001, "http://hub.info/y", "")]
    rules = [url_graph.Rule("block", "hub.info", "/")]
    got = {r.page_id: r for r in url_graph.judge_urls(spark.createDataFrame(pages, "page_id long, url string, html string"), rules).collect()}
    assert all(got[n].verdict == ("block" if n % 2 else "allow") for n in range(400))


# ---- packing


def test_packing(spark):
    rng = random.Random(9)
    rows = [(n, " ".join(rng.choices(["ab", "cdé", "  x", "<|endoftext|>", "\n y"], k=int(2 ** rng.uniform(0, 11)))), "c") for n in range(120)]
    rows += [(200, None, "c"), (201, "", "c"), (202, "a b " * 40_000, "c"), (5, rows[5][1], "c"), (None, "z", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, offset string").repartition(3)
    got = packing.pack_documents(df, BYTES, group_docs=40).toPandas()
    library = Tokenizer.from_file(BYTES)
    tokens = {}
    for i, t, _ in rows:
        tokens[i] = library.encode(t or "", add_special_tokens=False).ids + [2]
    for r in got.itertuples():
        i = None if r.doc_id != r.doc_id else int(r.doc_id)
        ids = np.array(tokens[i][r.start : r.start + r.length], "<u4").tobytes()
        assert r.ids == ids and r.ids_crc32 == zlib.crc32(ids)
    assert got.length.sum() == sum(len(tokens[i]) for i, *_ in rows)
    assert (got[got.piece > 0].length == 1024).all()
    for _, s in got.sort_values("offset").groupby("sequence_id"):
        assert s.offset.tolist() == [0, *np.cumsum(s.length)[:-1]] and s.length.sum() <= 1024
    assert packing.pack_documents(df.limit(0), BYTES).count() == 0


def test_sum_of_squares_is_close_to_the_bound():
    sizes = np.sort(np.random.default_rng(1).integers(1, 1024, 3000))[::-1]
    sequence, offset = packing.sum_of_squares(sizes, 1024)
    filled = np.bincount(sequence, weights=sizes)
    assert filled.max() <= 1024 and len(filled) <= 1.02 * max(-(-sizes.sum() // 1024), (sizes > 512).sum())


def test_byte_bpe_matches_the_library():
    rng = random.Random(2)
    library, own = Tokenizer.from_file(BYTES), packing.ByteBpe(BYTES)
    alphabet = "aab'stre  ΑΣ<|endoftext|>é\u0301\x1c\x85\xa0\u3000\n\t12²!#😀字한 "
    for _ in range(2000):
        t = "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 25))) + rng.choice(["", "<|endoftext|>", "'s  \n"])
        assert np.frombuffer(own.encode(t), "<u4").tolist() == library.encode(t, add_special_tokens=False).ids
