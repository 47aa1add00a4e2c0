import pytest
from pyspark.sql import functions as F

from cairn.functions.hashing import content_hash
from cairn.operators import catalog as C
from cairn.operators import chunks as K
from cairn.operators import diagnostics as G
from cairn.operators import replication as R
from cairn.operators import routing as T
from cairn.operators import spans as P


def spans(spark, *pairs):
    return spark.createDataFrame([("g", a, b) for a, b in pairs], "g string, first int, last int")


@pytest.mark.parametrize(
    "pairs, full, gaps",
    [
        ([(0, 255)], True, []),
        ([(0, 127), (128, 255)], True, []),
        ([(0, 63), (128, 255)], False, [(64, 127)]),
        ([(0, 144), (128, 255)], True, []),
        ([(255, 0)], True, []),
        ([(128, 255), (0, 127)], True, []),
        ([(10, 20), (30, 40)], False, [(0, 9), (21, 29), (41, 255)]),
    ],
)
def test_span_cases(spark, pairs, full, gaps):
    s = spans(spark, *pairs)
    assert P.is_full(s, "g").head().full == full
    assert sorted((r["first"], r["last"]) for r in P.missing(s, "g").collect()) == gaps


def test_span_equality(spark):
    a, b = spans(spark, (0, 10), (11, 20)), spans(spark, (0, 20))
    assert P.equal(a, b, "g").head().equal and not P.equal(a, spans(spark, (0, 19)), "g").head().equal


@pytest.mark.parametrize("n, replications", [(1, 1), (3, 1), (5, 2), (7, 3), (2, 2)])
def test_assigned_spans_cover_everything_often_enough(spark, n, replications):
    servers = spark.createDataFrame([(f"s{i}", 100 + 37 * i) for i in range(n)], "host string, capacity long")
    got = P.assign(servers, "host", "capacity", replications).collect()
    cover = [sum(r["first"] <= p <= r["last"] for r in got) for p in range(256)]
    assert min(cover) >= min(replications, n)


def test_circular_portion(spark):
    rows = spark.createDataFrame([(c,) for c in "abcdefghij"], "host string")
    names = lambda a, b: "".join(r.host for r in C.host_portion(rows, a, b).orderBy("turn", "host").collect())
    assert names("b", "i") == "bcdefgh" and names("i", "b") == "ija" and names("c", "c") == "cdefghijab"


def test_status_offline_wins(spark):
    rows = spark.createDataFrame([("a", 1, 5, 9, False, 1), ("a", 2, 7, 3, True, 2)], "host string, flags int, update_ts int, response_ts int, online boolean, seq int")
    r = C.status_upsert(rows).head()
    assert (r.flags, r.response_ts, r.online) == (2, 9, False)


def test_reassemble_and_corruption(spark):
    files = spark.createDataFrame([(1, "x" * 2500), (2, ""), (3, "é" * 10)], "id long, text string")
    parts = K.cut(files, "id", "text").withColumn("hash", content_hash(F.col("chunk")))
    stored = K.store(parts)
    whole = {r.id: r.text for r in K.reassemble(parts, stored, "id").collect()}
    assert whole == {1: "x" * 2500, 2: "", 3: "é" * 10}
    lost = K.reassemble(parts, stored.where("chunk != ''"), "id").where("id = 2").head()
    assert lost.text is None
    assert K.corrupt(stored.withColumn("chunk", F.concat("chunk", F.lit("!")))).count() == stored.count()
    assert K.insert_new(stored, stored.unionByName(parts.select("hash", "chunk"))).count() == 0


def test_replication_plan_prefers_span(spark):
    held = spark.createDataFrame([("c", "a")], "hash string, host string")
    cand = spark.createDataFrame([("c", h, s) for h, s in (("a", True), ("b", False), ("d", True), ("e", False))], "hash string, host string, in_span boolean")
    assert sorted(r.host for r in R.plan(held, cand, 3).collect()) == ["b", "d"]


def test_cover():
    assert T.cover([("a", 0, 100), ("b", 50, 255), ("c", 0, 60)]) == ["a", "b"] and T.cover([("a", 0, 10)]) == []


def test_version_chain(spark):
    v = spark.createDataFrame([(1, 2), (2, 3), (3, None), (9, None)], "id long, next long")
    assert sorted(map(tuple, C.version_chain(v).collect())) == [(1, 1, 0), (1, 2, 1), (1, 3, 2), (9, 9, 0)]


def test_version_chain_of_any_length(spark):
    v = spark.range(1500).selectExpr("id", "CASE WHEN id < 1499 THEN id + 1 END AS next")
    assert sorted(map(tuple, C.version_chain(v).collect())) == [(0, k, k) for k in range(1500)]
    with pytest.raises(ValueError):
        C.version_chain(spark.createDataFrame([(1, 2), (2, 3), (3, 2)], "id long, next long"))


def test_request_depth_goes_to_the_end(spark):
    links = spark.createDataFrame([(str(k), str(k + 1)) for k in range(18)] + [("18", "0")], "src string, dst string")
    assert sorted(map(tuple, C.request_depth(links, "0").collect())) == sorted((str(k), k) for k in range(19))


def test_batches_hold_one_batch(spark):
    """Several Arrow batches for one host, and no array of a host's rows in the plan."""
    sizes = [(k * 7919) % 50 for k in range(30000)]
    df = spark.createDataFrame([("a", k, x) for k, x in enumerate(sizes)] + [(None, 1, 5), ("b", 2, None), ("b", 1, 4)], "host string, seq long, size long")
    out = G.batches(df.repartition(4), "host", ["seq"], "size", 300, 20)
    want, n, total = [], 0, 0
    for x in sizes:
        if n and (total >= 300 or n >= 20):
            want.append((n, total))
            n = total = 0
        n, total = n + 1, total + x
    got = out.collect()
    assert [(r.n, r.bytes) for r in sorted((r for r in got if r.host == "a"), key=lambda r: r.batch)] == [*want, (n, total)]
    assert sorted((r.host or "", r.batch, r.n, r.bytes) for r in got if r.host != "a") == [("", 0, 1, 5), ("b", 0, 2, 4)]
    assert "collect_list" not in out._jdf.queryExecution().toString()



def test_interval_join_with_and_without_broadcast(spark, monkeypatch):
    chunks = spark.range(256).selectExpr("id AS hash", "CAST(id AS INT) AS place")
    s = spark.createDataFrame([("a", 0, 9), ("b", 5, 255)], "host string, first int, last int")
    small = sorted(map(tuple, T.in_spans(chunks, s).select("hash", "host").collect()))
    monkeypatch.setattr(T, "MAX_SPANS", 1)
    assert sorted(map(tuple, T.in_spans(chunks, s).select("hash", "host").collect())) == small and len(small) == 261


def test_metadata_without_encodings(spark):
    from cairn.operators import metadata as M

    df = spark.sql("SELECT array() AS x").select(F.col("x").cast("array<struct<name:string,hash:string,passphrase:string>>").alias("e")).unionByName(spark.sql("SELECT cast(null AS array<struct<name:string,hash:string,passphrase:string>>) AS e"))
    for r in df.select(M.data_hash(F.col("e")).alias("a"), M.stored_hash(F.col("e")).alias("b")).collect():
        assert tuple(r) == (None, None)


def test_numbered_is_dense(spark):
    from cairn.operators import metadata as M

    df = spark.range(5000).select((F.col("id") * 7919 % 5003).alias("k"))
    got = [(r.k, r.n) for r in M.numbered(df.repartition(5), [F.desc("k")]).collect()]
    assert sorted(got, reverse=True) == [(k, n + 1) for n, k in enumerate(sorted((i * 7919 % 5003 for i in range(5000)), reverse=True))]
    assert M.numbered(df.limit(0), [F.col("k")]).count() == 0


def test_download_sources_named_only(spark):
    servers = spark.createDataFrame([("a", True, True, True, 3, 0, 9), ("b", True, True, False, 1, 0, 255), ("c", False, True, True, 0, 0, 255), ("x", False, False, False, 7, 0, 0)], "host string, is_online boolean, is_readable boolean, is_writable boolean, outstanding long, first int, last int")
    chunks = spark.createDataFrame([("h", 50)], "hash string, place int")
    pick = lambda **k: [(r.host, r.tier) for r in T.download_sources(chunks, servers, servers.select("host", "first", "last"), **k).orderBy("rank").collect()]
    assert pick() == [("b", 1), ("a", 3)] and pick(wanted=1) == [("b", 1)]
    assert pick(preferred=["a"], external=["x"]) == [("a", 0), ("b", 1), ("x", 2)]
    assert pick(preferred=["a"], unspecified=False) == [("a", 0)]


def test_hashed_keys_are_not_broadcast(spark, sf):
    """The file of keys is small, what is hashed from it is not."""
    from cairn.plans.queries import QUERIES

    for name in ("get_metadata", "has_data"):
        assert "Broadcast" not in QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
    for name in ("heal_download", "drain_targets", "delete_everywhere", "heal_pages"):
        plan = QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin [p_partkey" in plan or "SortMergeJoin [l_partkey" in plan


def test_line_items_are_dealt_by_their_number(spark, sf, monkeypatch):
    """Tasks grow with the rows, not only with the session's partitions."""
    from cairn.plans import domain as D
    from cairn.plans.queries import QUERIES
    from verify import rows

    before = {name: rows(QUERIES[name](spark, sf).toPandas()) for name in ("replication_count", "retry_sources")}
    monkeypatch.setattr(D, "TASK_ROWS", 100)
    tasks = -(-D.table(spark, sf, "lineitem").count() // 100)
    assert D.supplied(spark, sf).rdd.getNumPartitions() == tasks > 8
    for name, want in before.items():
        got = QUERIES[name](spark, sf)
        assert f", {tasks})" in got._jdf.queryExecution().executedPlan().toString() and rows(got.toPandas()) == want


def test_many_spans_pair_in_blocks(spark, monkeypatch):
    """Blocks give the pairs that a broadcast gives, copies of chunks and spans included, and only blocks meet in the join."""
    chunks = spark.range(512).selectExpr("id AS hash", "CAST(id % 256 AS INT) AS place").union(spark.createDataFrame([(7, 7), (7, 7)], "hash long, place int"))
    s = spark.createDataFrame([(f"s{k}", k * 37 % 256, min(255, k * 37 % 256 + 40)) for k in range(50)] + [("s1", 37, 77)], "host string, first int, last int")
    pick = lambda: sorted(map(tuple, T.in_spans(chunks, s).select("hash", "place", "host", "first", "last").collect()))
    want = pick()
    monkeypatch.setattr(T, "MAX_SPANS", 1)
    monkeypatch.setattr(T, "BLOCK", 3)
    assert pick() == want
    assert "inline(" in T.in_spans(chunks, s)._jdf.queryExecution().optimizedPlan().toString()


def test_tasks_write_few_chunks(spark, monkeypatch):
    """Pairs of many spans come out by places, few chunks to a task and block by block, so that files of them stay small; chunks of one place may be dealt to several tasks."""
    chunks = spark.range(2048).selectExpr("id AS hash", "CAST(id % 256 AS INT) AS place").unionByName(spark.createDataFrame([(5000, None), (5001, 300)], "hash long, place int"))
    s = spark.createDataFrame([(f"s{k:02}", k * 37 % 256, min(255, k * 37 % 256 + 40)) for k in range(50)], "host string, first int, last int")
    want = sorted(map(tuple, T.in_spans(chunks, s).select("hash", "host").collect()))
    monkeypatch.setattr(T, "MAX_SPANS", 1)
    monkeypatch.setattr(T, "BLOCK", 4)
    for most, tasks in ((64, 33), (4, 768)):
        monkeypatch.setattr(T, "TASK_CHUNKS", most, raising=False)
        out = T.in_spans(chunks, s).select("hash", "place", "host", F.spark_partition_id().alias("task"))
        got = out.toPandas()
        assert sorted(zip(got["hash"], got["host"])) == want and out.rdd.getNumPartitions() == tasks
        assert got.groupby("task")["hash"].nunique().max() <= 64 and got.groupby("task")["place"].nunique().max() <= 8
        for _, rows in got.groupby(["task", "place"]):
            blocks = rows["host"].map({h: k // 4 for k, h in enumerate(sorted(rows["host"].unique()))})
            assert blocks.is_monotonic_increasing


def _routing_case(spark):
    servers = spark.createDataFrame(
        [(f"s{k:02}", k % 3 != 0, k % 7 != 0, k % 5 != 0, k % 4 != 0, k % 11, k * 37 % 256, min(255, k * 37 % 256 + 40)) for k in range(60)],
        "host string, is_core boolean, is_online boolean, is_readable boolean, is_writable boolean, outstanding long, first int, last int",
    )
    chunks = spark.range(256).selectExpr("concat('h', id) AS hash", "CAST(id AS INT) AS place")
    return servers, servers.select("host", "first", "last"), chunks


def test_upload_targets_compare_no_pairs(spark, monkeypatch):
    """Each pair once, with sticky hosts that are routed too, twice named, or of an unknown chunk; pairs themselves are not made distinct."""
    servers, spans, chunks = _routing_case(spark)
    sticky = spark.createDataFrame([("h3", "s01"), ("h3", "s01"), ("h40", "s01"), ("zz", "s59"), ("h3", None)], "hash string, host string")
    able = [r for r in servers.collect() if r.is_core and r.is_online and r.is_writable]
    want = {(f"h{p}", r.host) for p in range(256) for r in able if r.first <= p <= r.last} | {(r.hash, r.host) for r in sticky.collect()}
    doubled = spans.unionByName(spans)
    for most in (T.MAX_SPANS, 1):
        monkeypatch.setattr(T, "MAX_SPANS", most)
        got = [tuple(r) for r in T.upload_targets(chunks.unionByName(chunks), servers, doubled, sticky).collect()]
        assert len(got) == len(set(got)) and set(got) == want
    plan = T.upload_targets(chunks, servers, spans)._jdf.queryExecution().optimizedPlan().toString()
    assert not plan.lstrip().startswith("Aggregate")


def test_sources_are_ranked_by_place(spark, monkeypatch):
    """Against a plain ranking of all servers for each chunk; places that no span holds have last-ditch sources only."""
    servers, spans, chunks = _routing_case(spark)
    more = chunks.unionByName(spark.createDataFrame([("none", None), ("far", 300)], "hash string, place int"))
    hosts = servers.collect()

    def plain(place, wanted, preferred, external):
        out = []
        for r in hosts:
            able, near = r.is_online and r.is_readable, place is not None and r.first <= place <= r.last
            own = 0 if r.is_writable else 1
            tier = own if able and near else (own if able else None) if r.host in preferred else 2 if r.host in external else 3 if able else None
            if tier is not None:
                out.append((tier, r.outstanding, r.host))
        return [(h, t) for t, _, h in sorted(out)][:wanted]

    for wanted, most in ((3, 4096), (30, 4096), (None, 4096), (None, 1)):
        monkeypatch.setattr(T, "MAX_SPANS", most)
        got = {}
        for r in T.download_sources(more, servers, spans, wanted, ["s02", "s07", "s12"], ["s09", "s12"]).orderBy("hash", "rank").collect():
            got.setdefault(r.hash, []).append((r.host, r.tier))
        assert got == {r.hash: plain(r.place, wanted, ["s02", "s07", "s12"], ["s09", "s12"]) for r in more.collect()}
    assert T.ranked(servers, spans, F.lit(0), F.lit(1), ["host"], 2).count() == 257 * 2


def test_plan_copies_picks_by_place(spark):
    servers, spans, chunks = _routing_case(spark)
    held = spark.createDataFrame([(f"h{p}", f"s{(p * k) % 60:02}") for p in range(256) for k in range(1, 1 + p % 6)], "hash string, host string")
    have, where = {}, {r.host: (r.first, r.last) for r in spans.collect()}
    for r in held.collect():
        have.setdefault(r.hash, set()).add(r.host)
    want = set()
    for h, own in have.items():
        inside = lambda x: where[x][0] <= int(h[1:]) <= where[x][1]  # noqa: B023, E731
        rest = sorted((x for x in where if x not in own), key=lambda x: (not inside(x), x))
        want |= {(h, x, inside(x)) for x in rest[: max(0, 4 - len(own))]}
    out = R.plan_copies(held, chunks, servers, 4)
    assert {tuple(r) for r in out.collect()} == want and "every" not in out._jdf.queryExecution().optimizedPlan().toString()


def test_routed_answers_go_by_copies(spark):
    """Only servers that hold a chunk are looked at: spans are not spread over places."""
    servers, spans, chunks = _routing_case(spark)
    held = chunks.selectExpr("hash", "place", "concat('s', lpad(place % 60, 2, '0')) AS host").unionByName(chunks.selectExpr("hash", "place", "concat('s', lpad(place * 7 % 60, 2, '0')) AS host"))
    where, met = {r.host: (r.first, r.last) for r in spans.collect()}, {}
    for r in held.collect():
        if where[r.host][0] <= r.place <= where[r.host][1]:
            met[r.hash] = min(r.host, met.get(r.hash, r.host))
    has, get = T.routed_has(chunks, spans, held), T.routed_get(chunks, spans, held)
    assert {r.hash: r.host for r in get.collect()} == met and {r.hash: r.found for r in has.collect()} == {f"h{p}": f"h{p}" in met for p in range(256)}
    assert all("explode" not in df._jdf.queryExecution().optimizedPlan().toString() for df in (has, get))


def test_span_counts_join_no_spans(spark):
    servers, spans, chunks = _routing_case(spark)
    rows = spans.collect()
    want = {f"h{p}": n for p in range(256) if (n := sum(r.first <= p <= r.last for r in rows))}
    assert {r.hash: r.n for r in T.span_counts(chunks, spans).collect()} == want


@pytest.mark.parametrize("alike", [True, False])
def test_heal_page_by_short_keys(spark, alike):
    """Pages by a short key are those by the hash itself, also where all hashes begin alike; b has one full page and no more, c has none."""
    name = lambda k: ("0" * 20 if alike else "") + f"{k * 7919 % 1000:03}" + "f" * 20
    text = F.concat(F.lit("0" * 20 if alike else ""), F.lpad((F.col("key") * 7919 % 1000).cast("string"), 3, "0"))
    held = [("a", k, k) for k in range(60)] + [("a", 7, 7), (None, 8, 8)] + [("b", k, 50) for k in range(5)] + [("c", k, 50) for k in range(3)] + [("d", 1, 255)]
    remote = spark.createDataFrame([(h, k, name(k), p) for h, k, p in held], "host string, key int, hash string, place int")
    local = spark.createDataFrame([(k, name(k)) for k in range(0, 60, 3)], "key int, hash string")
    want = {h: sorted({name(k) for g, k, p in held if g == h and 2 <= p <= 55}) for h in "abc"}
    lacks = lambda hashes: {x for x in hashes if x not in {name(k) for k in range(0, 60, 3)}}
    for short in ({}, {"by": "key", "hashed": F.concat(text, F.lit("f" * 20)), "begins": text, "tasks": 3}):
        after, done = spark.createDataFrame([], "host string, after string"), {}
        for turn in range(3):
            page, cursors = R.heal_page(remote, local, after, 2, 55, 5, known=turn > 0, **short)
            for r in page.collect():
                done.setdefault((r.host, turn), set()).add(r.hash)
            at = {r.host: r.after for r in cursors.collect()}
            assert at == {h: full[turn * 5 : turn * 5 + 5][-1] if len(full[turn * 5 :]) >= 5 else None for h, full in want.items() if full[turn * 5 :]}
            after = spark.createDataFrame([x for x in at.items() if x[1]], "host string, after string")
        assert done == {(h, t): x for h, full in want.items() for t in range(3) if (x := lacks(full[t * 5 : t * 5 + 5]))}


def test_heal_pages_deals_no_hashes(spark, sf):
    """What is dealt to hosts is part keys; hashes are made after that."""
    from cairn.plans.queries import QUERIES

    lines = QUERIES["heal_pages"](spark, sf)._jdf.queryExecution().executedPlan().toString().splitlines()
    depth = lambda line: len(line) - len(line.lstrip(" :+-"))
    dealt = [k for k, line in enumerate(lines) if "Exchange hashpartitioning(host" in line]
    below = [line for k in dealt for line in lines[k + 1 : next((j for j in range(k + 1, len(lines)) if depth(lines[j]) <= depth(lines[k])), len(lines))]]
    assert dealt and not any("sha1(" in line for line in below)
