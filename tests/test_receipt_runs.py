"""Receipt runs: few files per lookup, levels, versions."""

import hashlib
import random

from ratelens.sources import receipt_runs as rr

SCHEMA = "fingerprint string, created_at long, value int, schema_version int, scheme_version int"


def fp(i):
    return hashlib.sha256(str(i).encode()).hexdigest()


def lookup(spark, root, keys):
    wanted = spark.createDataFrame([(k, "x") for k in keys], "fingerprint string, value string")
    return {r.fingerprint: r.value for r in rr.lookup_fingerprints(spark, root, wanted).collect()}


def test_lookups_read_few_files(spark, tmp_path):
    root, rng, newest = str(tmp_path / "receipts"), random.Random(1), {}
    for batch in range(3):
        rows = [(fp(i), batch, batch * 10_000 + i, 1, 1) for i in rng.sample(range(4_000), 1_500)]
        newest |= {r[0]: r[2] for r in rows}
        rr.append_run(spark, root, spark.createDataFrame(rows, SCHEMA), per_file=100)
    everything = rr.receipt_files(spark, root, spark.createDataFrame([(k,) for k in newest], "fingerprint string"))
    assert len(everything) >= 40
    for keys in ([next(iter(newest))], [fp(10**6)], [*list(newest)[:3], "", "zz", None]):
        files = rr.receipt_files(spark, root, spark.createDataFrame([(k,) for k in keys], "fingerprint string"))
        assert len(files) <= 3 * len(keys) + 1 and set(files) <= set(everything)
        assert lookup(spark, root, keys) == {k: newest[k] for k in keys if k in newest}
    assert lookup(spark, root, list(newest)) == newest
    # One hot fingerprint of many receipts.
    rr.append_run(spark, root, spark.createDataFrame([(fp(0), 100 + i, i, 1, 1) for i in range(900)], SCHEMA), per_file=100)
    assert lookup(spark, root, [fp(0)]) == {fp(0): 899}


def test_levels_and_versions(spark, tmp_path):
    root = str(tmp_path / "receipts")
    assert rr.lookup_fingerprints(spark, root, spark.createDataFrame([("a",)], "fingerprint string")) is None
    newest = {}
    for batch in range(9):
        rows = [(fp(i), batch, batch * 100 + i, 1, 1) for i in range(batch, batch + 20)] + [(fp(batch), 99, -1, 2, 1), (None, 1, 1, 1, 1)]
        newest |= {r[0]: r[2] for r in rows[:20]}
        rr.append_run(spark, root, spark.createDataFrame(rows, SCHEMA), fanout=3)
        rr.append_run(spark, root, spark.createDataFrame([], SCHEMA), fanout=3)
    assert [level for _, level in rr._runs(rr._index(spark, root))] == [2]
    assert lookup(spark, root, list(newest)) == newest
    gone = rr.drop_replaced(spark, root)
    assert len(gone) == 12 and rr.drop_replaced(spark, root) == []
    assert lookup(spark, root, list(newest)) == newest
