"""Faults that the third review found."""

import random
import time
import tracemalloc

import pandas as pd
from pyspark.sql import functions as F


def test_differencing_grows_with_its_items():  # every join copied the items of its sets
    from tidemill.operators.balance import differencing

    random.seed(3)
    loads = [random.randint(1, 300) for _ in range(100_000)]
    at = time.process_time()
    for k in (1, 2, 4):
        sets = differencing(loads, k)
        assert sorted(i for s in sets for i in s) == list(range(len(loads)))
        sums = [sum(loads[i] for i in s) for s in sets]
        assert max(sums) - min(sums) <= 300
    assert time.process_time() - at < 30


def test_micro_batches_hold_no_empty_sets():  # every group was a state of as many sets as there are micro-batches
    from tidemill.operators.balance import micro_batches

    random.seed(4)
    lengths = [random.randint(1, 300) for _ in range(12_000)]
    groups = [i // 4 for i in range(len(lengths))]
    tracemalloc.start()
    sets = micro_batches(lengths, 1024, groups)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sorted(i for s in sets for i in s) == list(range(len(lengths))) and all(sets)
    assert len({(groups[i], n) for n, s in enumerate(sets) for i in s}) == 3000
    assert peak < 20_000_000


def test_responses_of_any_width(spark, tmp_path):  # places behind the 16th were not counted
    from tidemill.plans.breadth import response_info

    lines = spark.range(60).select(
        F.when(F.col("id") < 40, 1).otherwise(2).alias("l_orderkey"), F.when(F.col("id") < 58, (F.col("id") + 1)).otherwise(F.col("id") - 57).cast("int").alias("l_linenumber"),
        *(F.lit(1).alias(c) for c in ("l_partkey", "l_suppkey")), *(F.lit(0.5).alias(c) for c in ("l_extendedprice", "l_discount", "l_quantity", "l_tax")),
        F.when(F.col("id") % 5 == 0, "R").otherwise("N").alias("l_returnflag"))
    lines.where("id < 40 OR id >= 57").write.parquet(f"{tmp_path}/lineitem.parquet")
    assert sorted(map(tuple, response_info(spark, str(tmp_path)).collect())) == [(1, 2, 30), (2, 3, 0)]


def test_requests_of_a_chunk_are_one_batch():  # a batch and a pass over all hashes for each bucket, of which there are more in larger inputs
    import numpy as np

    from tidemill.llm.substrings import _by_bucket, _by_words, _words

    bucket = np.random.default_rng(1).integers(0, 50, 999)
    got = _by_bucket(bucket)
    assert [b for b, _ in got] == np.unique(bucket).tolist() and all((at == np.flatnonzero(bucket == b)).all() for b, at in got)
    assert _by_bucket(bucket[:0]) == []
    for alphabet in (1, 2, 30):  # words that all agree, in part and not at all
        text = np.concatenate([np.random.default_rng(2).integers(1, 1 + alphabet, 600).astype(np.uint8)] * 2 + [np.zeros(70, np.uint8)])
        cut = [text[i : i + 56].tobytes() for i in _by_words(np.arange(0, 1200, 3), _words(text)).tolist()]
        assert cut == sorted(cut) and len(cut) == 400


def test_small_parts_share_a_task(spark, tmp_path):  # a task for every 4,001 bytes
    from tidemill.sources import datasets as R

    (tmp_path / "x.jsonl").write_text("".join(f'{{"id": {i}, "text": "{"ä" * (i % 90)}"}}\n' for i in range(20_000)))
    reader = R.RowReader({"path": str(tmp_path / "x.jsonl"), "splitBytes": "101"}, R.T.StructType.fromDDL("id bigint, text string"))
    parts = reader.partitions()
    assert 60 < len(parts) < 80
    batches = [b for p in parts for b in reader.read(p)]
    assert [r for b in batches for r in b.column("id").to_pylist()] == list(range(20_000)) and len(batches) == len(parts)
    assert [len(r) for b in batches for r in b.column("text").to_pylist()] == [i % 90 for i in range(20_000)]


def test_no_task_sees_a_whole_step(spark):  # rows met their step by a join on it, so all rows of a step met in one task
    from tidemill.operators.batch import ROW
    from tidemill.operators.deal import _with_steps

    order = spark.range(1000).select(F.col("id").alias(ROW), F.when(F.col("id") < 300, None).when(F.col("id") < 310, 1).otherwise(2).alias("step"))
    steps = order.groupBy(F.col("step").alias("__step")).agg(F.min(ROW).alias("__from"), F.count("*").alias("__n"))
    old = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    try:
        for k in old:
            spark.conf.set(k, "false" if k.endswith("enabled") else "-1")
        got = _with_steps(order, "step", steps, run=64).withColumn("task", F.spark_partition_id()).collect()
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert sorted((r[ROW], r.step, r["__from"], r["__n"]) for r in got) == [(i, *((None, 0, 300) if i < 300 else (1, 300, 10) if i < 310 else (2, 310, 690))) for i in range(1000)]
    assert len({r.task for r in got if r.step == 2}) > 1


class Store:
    """What a processor keeps for one key, and how often it asked for it."""

    def __init__(self):
        self.calls, self.maps, self.lists, self.values, self.timers = 0, {}, {}, {}, set()

    def _handle(self, kind, name):
        store = self

        class Handle:
            def __getattr__(self, call):
                store.calls += 1
                held, own = getattr(store, kind), {"maps": {}, "lists": [], "values": None}[kind]
                mine = held.setdefault(name, own)
                return {
                    "get": lambda: iter(list(mine)) if kind == "lists" else mine, "exists": lambda: bool(mine), "update": lambda v: held.update({name: v}), "clear": lambda: held.update({name: own}),
                    "removeKey": lambda k: mine.pop(k, None), "containsKey": lambda k: k in mine, "getValue": lambda k: mine.get(k), "updateValue": lambda k, v: mine.update({k: v}), "iterator": lambda: iter(list(mine.items())),
                    "put": lambda v: held.update({name: list(v)}), "appendList": lambda v: mine.extend(v), "appendValue": lambda v: mine.append(v)}[call]

        return Handle()

    def getMapState(self, name, *_):
        return self._handle("maps", name)

    def getListState(self, name, *_):
        return self._handle("lists", name)

    def getValueState(self, name, *_):
        return self._handle("values", name)

    def registerTimer(self, at):
        self.timers.add(at)

    def deleteTimer(self, at):
        self.timers.discard(at)


def test_queues_ask_for_items_together(monkeypatch):  # F11, F16: a call to the store for every item that came, and one for every item that went
    from collections import deque

    from tidemill.streaming import state

    r = random.Random(5)
    for most in (1, 5, 8, 9, 30, 300):
        monkeypatch.setattr(state, "BLOCK", 8, raising=False)
        q, store, want, came, calls = state.Queue(most, "k", "item"), Store(), deque(maxlen=most), 0, 0
        q.init(store)
        for n in [1, 0, 7, 8, 3, 100, 16, 1, 1, 250, *(r.randrange(1, 40) for _ in range(60))]:
            if not n:
                continue
            items, before, at = [r.randrange(1000) for _ in range(n)], store.calls, len(want) + n - min(most, len(want) + n)
            want.extend(sorted(items))
            came += n
            (out,) = q.handleInputRows(("a",), iter([pd.DataFrame({"item": items})]), None)
            assert tuple(out.iloc[0]) == ("a", len(want), came, came - len(want), want[0], want[-1], n, at)
            calls = max(calls, (store.calls - before) / (n + 8))
        assert calls < 1 and len(store.maps.get("blocks", {})) <= most // 8 + 2
    assert len(store.maps["blocks"]) > 30


def test_batches_wait_together():  # an entry of the list for every item that waits
    from tidemill.streaming.state import Batches

    b, store = Batches(100, "k", "item"), Store()
    b.init(store)
    got = [x for n in (30, 40, 29, 5, 250) for pdf in b.handleInputRows(("a",), iter([pd.DataFrame({"item": range(n)})]), None) for x in pdf.itertuples(index=False, name=None)]
    assert [x[1] for x in got] == [i // 100 for i in range(300)] and [x[2] for x in got] == [*range(30), *range(40), *range(29), *range(5), *range(196)]
    assert len(store.lists["waiting"]) == 1


def test_tags_are_kept_together(monkeypatch):  # three calls to the store for every tag
    from tidemill.streaming import state

    r = random.Random(6)
    monkeypatch.setattr(state, "CHUNK", 50)
    for stuck in (False, True):
        p, store, want = state.Replay(1000, "string"), Store(), {}
        p.init(store)
        for _ in range(30):
            tags = [(f"k{r.randrange(300)}", r.randrange(50), r.choice(list(state.RANK))) for _ in range(r.randrange(1, 80))]
            for k, at, status in tags:
                want[k] = max(want.get(k, (-1, -1)), (at, state.RANK[status]))
            assert list(p.handleInputRows(("p", 1), iter([pd.DataFrame(tags, columns=["key", "at_ms", "status"])]), None)) == []
        ends = [(k, 99, "failure") for k, (_, rank) in want.items() if rank == 0][1 if stuck else 0 :]
        list(p.handleInputRows(("p", 1), iter([pd.DataFrame(ends, columns=["key", "at_ms", "status"])]), None))
        assert store.timers == {1099} and store.calls < 700  # of 1,200 tags or so
        assert sum(len(chunk[0]) for part in store.lists.values() for chunk in part) < 16 * 50 + 3 * len(want)
        got = [x for pdf in p.handleExpiredTimer(("p", 1), None, None) for x in pdf["key"]]
        assert sorted(got) == ([] if stuck else sorted(k for k, (_, rank) in want.items() if rank == 2))
        assert bool(store.values["step"]) == stuck and any(store.lists.values()) == stuck


def test_replay_state_is_kept_by_the_engine(spark, tmp_path):  # a Python call for each key of each micro-batch
    from tidemill.streaming.events import run_to_table
    from tidemill.streaming.samples import replay_stream

    schema = "at long, partition_id string, key long, op string, status string, step long, more int"
    files = [[(5, "p", 1, "put", "running", 2, 0), (7, "p", 2, "put", "success", 3, 0), (1, None, 1, "put", "failure", 1, 0)], [(4, "p", 1, "put", "success", 1, 0), (9, "p", 2, "remove", "success", 3, 0)], [(5, "p", 1, "put", "success", 4, 0), (2, "p", 3, "put", "running", 9, 0), (2, "p", 3, "put", "failure", 8, 0)]]
    for rows in files:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        time.sleep(1.1)
    stream = replay_stream(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in"))
    assert not any(w in stream._jdf.queryExecution().logical().toString() for w in ("Pandas", "Arrow", "Python"))
    got = run_to_table(stream, f"{tmp_path}/out", "update", ["partition_id", "key"])
    assert sorted(map(tuple, got.collect()), key=repr) == sorted([("p", 1, "success", 4, False), ("p", 2, "success", 3, True), ("p", 3, "running", 9, False), (None, 1, "failure", 1, False)], key=repr)


class Rows:
    """A table that runs a function of batches at once."""

    def __init__(self, pdf, dtypes):
        self.pdf, self.dtypes, self.columns = pdf, dtypes, list(pdf.columns)

    def where(self, _):
        return self

    def mapInPandas(self, work, _):
        return pd.concat(work(iter([self.pdf])), ignore_index=True)


def test_majorities_are_counted_once_for_like_votes(monkeypatch):  # draws were counted anew for each prompt
    import numpy as np

    from tidemill.operators import resampling as R

    r, rows = np.random.default_rng(7), []
    for uid in range(900):
        n = int(r.integers(2, 6))
        rows.append((uid, n, r.normal(size=n).tolist(), [None if v == 0 else str(v) for v in r.integers(0, 3, n)]))
    rows.append((900, 40, r.normal(size=40).tolist(), [str(v) for v in r.integers(0, 9, 40)]))
    rule, calls = R.majority_values, []
    monkeypatch.setattr(R, "majority_values", lambda *a: calls.append(1) or rule(*a))
    got = R.majorities(Rows(pd.DataFrame(rows, columns=["uid", "n", "xs", "votes"]), [("uid", "bigint")]), 50, 3)
    assert len(calls) < 400  # of 2,000 or so
    want = {}
    for uid, n, xs, votes in rows:
        codes = pd.factorize(pd.Series(votes, dtype=object), use_na_sentinel=False)[0]
        for k in R.sizes(n):
            drawn = rule(np.array(xs), codes, R.places(n, k, 50, 3))
            want[uid, k] = drawn.mean(), drawn.std()
    assert len(got) == len(want)
    for uid, k, mean, std in got[["uid", "k", "maj_mean", "maj_std"]].itertuples(index=False, name=None):
        assert np.allclose((mean, std), want[uid, k], atol=1e-9)


def test_sketches_are_as_fine_as_the_share_needs(spark, monkeypatch):  # a sketch of up to a million values came from each task to one
    from tidemill.functions.losses import _with_first

    quantile, asked = F.percentile_approx, []
    monkeypatch.setattr(F, "percentile_approx", lambda c, p, accuracy: asked.append(accuracy) or quantile(c, p, accuracy))
    rows = spark.range(0, 20_000, 1, 8).select(F.col("id").alias("seq_id"), F.lit(0).alias("pos"), F.lit(20_000).alias("__n"), F.pmod(F.col("id") * 7919, F.lit(5003)).cast("double").alias("__by"))
    for ratio, most in ((0.01, 1000), (0.0002, 40_000), (0.3, 1000), (1.0, 1000), (1e-9, 1_000_000)):
        out = _with_first(rows, rows, ratio)
        assert asked.pop() == most
        order = sorted(range(20_000), key=lambda i: (-float(i * 7919 % 5003), i))
        assert {r.seq_id for r in out.where("__s IS NOT NULL").collect()} == set(order[: max(1, int(20_000 * ratio))])


def test_queues_and_batches_by_shard(spark, tmp_path):  # a Python call for each key of each micro-batch
    from collections import defaultdict

    from tidemill.streaming import samples as Q
    from tidemill.streaming.events import run_to_table

    r = random.Random(8)
    big = 2**60 + 1
    files = [[(r.choice([None, big, *range(40)]), r.choice([None, *range(1000)])) for _ in range(n)] for n in (300, 5, 200)]
    queues = defaultdict(list)
    for rows in files:
        spark.createDataFrame(rows, "k long, item int").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        for k, x in sorted((row for row in rows if row[1] is not None), key=lambda row: row[1]):
            queues[k].append(x)
        time.sleep(1.1)
    read = lambda: spark.readStream.schema("k long, item int").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    for shards in (1, 7):
        got = run_to_table(Q.queue_counts(read(), "k", "item", 8, shards), f"{tmp_path}/queue{shards}", "update", ["k"])
        want = [(k, len(v[-8:]), len(v), len(v) - len(v[-8:]), v[-8:][0], v[-1]) for k, v in queues.items()]
        assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)
        got = run_to_table(Q.count_batches(read(), "k", "item", 4, shards), f"{tmp_path}/batch{shards}")
        assert sorted(map(tuple, got.collect()), key=repr) == sorted(((k, i // 4, x) for k, v in queues.items() for i, x in enumerate(v[: len(v) // 4 * 4])), key=repr)


def test_neighbours_come_in_batches_of_bounded_size(spark, monkeypatch):  # a batch held 10,000 rows, however long
    from tidemill import session
    from tidemill.operators import prefixes

    asked = []
    monkeypatch.setattr(prefixes, "cut", lambda df: asked.append(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")) or session.cut(df))
    before = spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")
    rows = spark.range(300).select(F.lit("").alias("g"), F.concat(F.array_repeat(F.lit("word"), 9000), F.array(F.col("id").cast("string"))).alias("tokens"))
    assert {r.shared for r in prefixes.neighbours(rows).collect()} == {0, 9000}
    assert asked == ["4m"] and spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == before


def test_scored_texts_come_in_batches_of_bounded_size(spark):  # a batch held 10,000 texts, however long
    from tidemill.functions import scoring

    spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
    seen = F.pandas_udf(lambda x: pd.Series([len(x)] * len(x)), "long")
    scoring.route(F.lit("openai/gsm8k"), F.lit(""), F.lit("12"), ["openai/gsm8k"])
    rows = spark.range(0, 400, 1, 1).select(F.concat(F.repeat(F.lit("x"), 100_000), F.col("id").cast("string")).alias("text"))
    got = rows.select(seen("text").alias("n")).collect()
    assert len(got) == 400 and max(r.n for r in got) < 60


def planted(n, width, seed=5):
    """n directions at random, a tenth of them near copies of others."""
    import numpy as np

    r = np.random.default_rng(seed)
    x = r.normal(size=(n, width))
    at = r.integers(0, n, n // 10)
    x[at] = x[r.integers(0, n, n // 10)] + 0.28 * r.normal(size=(n // 10, width))
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def test_vectors_meet_once_and_leave_out_most_others():  # op2_embeddings: a vector was compared with nearly all others, each pair twice in each block
    import numpy as np

    from tidemill.llm import embeddings

    x = planted(40_000, 64)
    at = time.thread_time()
    left, right = embeddings.linked(x, len(x), True, 1, 0.95)
    assert time.thread_time() - at < 6
    dist = ((embeddings.rotated(x[left]) - embeddings.rotated(x[right])) ** 2).reshape(len(left), 4, 16).sum(2)
    assert (left != right).all() and len({(min(p), max(p)) for p in zip(left.tolist(), right.tolist(), strict=True)}) == len(left) > 300
    assert ((dist <= 0.025 + 1e-6).argmax(1) == 1).all()

    # of each pair within budget in a block one stands as host in just one cell that the other comes to
    y = embeddings.rotated(planted(1500, 32))
    radius = np.sqrt(0.1 / 2)
    for block in embeddings.blocks(32):
        host, stands = {}, {}
        for rows, cell, own in embeddings.cells(y, block, radius):
            for i, c in zip(rows.tolist(), cell.tolist(), strict=True):
                stands.setdefault(i, set()).add(c)
                if own:
                    host[i] = c
        close = ((y[:, None, block] - y[None, :, block]) ** 2).sum(2) <= 0.05
        pairs = [(i, j) for i, j in zip(*np.nonzero(close), strict=True) if i < j]
        assert len(pairs) > 50 and all(len({host[i], host[j]} & stands[i] & stands[j]) == 1 for i, j in pairs)


def test_range_join_loses_no_pair(monkeypatch):  # op2_embeddings: cuts to sets of any size, of vectors that lie apart, in groups, all alike or on few values
    import numpy as np

    from tidemill.llm import embeddings

    r = np.random.default_rng(6)
    sets = [planted(700, 16) * 0.5, r.normal(size=(6, 16))[r.integers(0, 6, 600)] * 0.1 + 0.01 * r.normal(size=(600, 16)), np.zeros((300, 16)), r.integers(0, 3, (400, 5)) * 0.1, r.normal(size=(500, 1)), np.zeros((0, 16)), np.ones((1, 3))]
    monkeypatch.setattr(embeddings, "STRIP", 37)
    for leaf in (50, 5_000, 1 << 22):
        monkeypatch.setattr(embeddings, "LEAF", leaf)
        for x in sets:
            u = np.ascontiguousarray(x.T, np.float32)
            d = ((u.T[:, None] - u.T[None]) ** 2).sum(2)
            for budget in (0.0251, 0.0051):
                sure, none = d <= budget - 1e-5, d > budget + 1e-5
                got = np.zeros(d.shape, int)
                for i, j in embeddings.near(u, None, budget):
                    assert (i < j).all() or leaf < 1 << 22
                    np.add.at(got, (np.minimum(i, j), np.maximum(i, j)), 1)
                assert got.max(initial=0) <= 1 and not np.tril(got).any() and got[np.triu(sure, 1)].all() and not got[none].any()
                half = len(x) // 3
                got = np.zeros((half, len(x) - half), int)
                for i, j in embeddings.near(u[:, :half], u[:, half:], budget):
                    np.add.at(got, (i, j), 1)
                assert got.max(initial=0) <= 1 and got[sure[:half, half:]].all() and not got[none[:half, half:]].any()


def test_large_cells_are_dealt_out_whole(spark, monkeypatch):  # op2_embeddings: strips of a cell meet once, each with itself and the later ones
    import numpy as np

    from tidemill.llm import embeddings

    x = planted(900, 24).astype(np.float32)
    x[:200] = x[0] + 0.01 * np.random.default_rng(1).normal(size=(200, 24))
    unit = x.astype(float) / np.sqrt((x.astype(float) ** 2).sum(1, keepdims=True))
    want = dict(enumerate(((unit @ unit.T) >= 0.95).sum(1) - 1))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    for most in (60_000, 100):
        monkeypatch.setattr(embeddings, "CELL", most)
        assert {r.vec_id: r.n_links for r in embeddings.near_vectors(df).collect()} == want
