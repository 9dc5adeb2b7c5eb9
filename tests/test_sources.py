import pytest
from pyspark.sql import functions as F

from conformance.stages import stages
from txnrisk import schema as S
from txnrisk.operators import graph, leakage
from txnrisk.session import checkpoint
from txnrisk.sources import tables

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def s(spark):
    return stages(spark, SF)


def written(s, folder, second):
    """Two files' worth of transactions; ``second`` changes the later half."""
    txn = s.txn.select(*S.TXN.fieldNames())
    txn.where("txn_id % 2 = 0").coalesce(1).write.parquet(str(folder))
    second(txn.where("txn_id % 2 = 1")).coalesce(1).write.mode("append").parquet(str(folder))
    return str(folder)


def test_a_sound_source_has_no_faults(spark, s, tmp_path):
    path = written(s, tmp_path / "a", lambda df: df)
    assert tables.source_report(spark, path).count() == 0
    tables.check_source(spark, path)


def test_faults_of_one_file_of_two_are_found(spark, s, tmp_path):
    missing = written(s, tmp_path / "b", lambda df: df.drop("payment_format"))
    found = tables.source_report(spark, missing).collect()
    assert [(r.column_name, r.issue) for r in found] == [("payment_format", "no value in file")]
    assert found[0].file.startswith("file:")
    extra = written(s, tmp_path / "c", lambda df: df.withColumn("note", F.lit("x")))
    assert [tuple(r) for r in tables.source_report(spark, extra).collect()] == [("note", "extra", None)]
    with pytest.raises(ValueError, match="note"):
        tables.check_source(spark, extra)
    typed = written(s, tmp_path / "d", lambda df: df.withColumn("from_bank", F.col("from_bank").cast("string")))
    with pytest.raises(Exception, match="from_bank"):
        tables.check_source(spark, typed)


def test_wrong_type_in_all_files(spark, s, tmp_path):
    path = str(tmp_path / "e")
    s.txn.withColumn("is_laundering", F.col("is_laundering").cast("long")).write.parquet(path)
    with pytest.raises(ValueError, match="type bigint, expected int"):
        tables.check_source(spark, path)


def test_hand_off_table_must_keep_its_contract(spark, s, tmp_path):
    path = str(tmp_path / "pair")
    tables.write_pair_txn(s.pair, path)
    assert tables.read_table(spark, path, S.GRAPH_PAIR_TXN).count() == s.pair.count()
    tables.write_pair_txn(s.pair.drop("g_reverse_pair_seen"), path)
    with pytest.raises(ValueError, match="g_reverse_pair_seen"):
        tables.read_table(spark, path, S.GRAPH_PAIR_TXN)
    nothing = str(tmp_path / "nothing")
    tables.write_clean(
        s.clean.withColumn("is_exact_dup", F.lit(False)).select(*S.CLEAN.fieldNames()).limit(0), nothing)
    assert tables.read_table(spark, nothing, S.CLEAN).count() == 0


def test_a_leak_ends_the_job(s):
    with pytest.raises(RuntimeError, match="pair_audit"):
        leakage.require_none({"pair_audit": leakage.pair_audit(
            s.clean, s.pair.withColumn("g_pair_seen_before", F.lit(1)))})


def test_pairs_that_see_their_own_day_move(s):
    """The same check on a table that counts the day itself, and on the real one."""
    dates = s.clean.select("txn_id", "txn_date")

    def real(txn):
        return graph.pair_history(txn, checkpoint(graph.build_edges(txn))).join(dates, "txn_id")

    def leaky(txn):
        n = txn.groupBy("src", "dst", "txn_date").agg(F.count(F.lit(1)).alias("n"))
        return txn.join(n, ["src", "dst", "txn_date"]).select("txn_id", "txn_date", "n").where("txn_id >= 0")

    def moved(build):
        return leakage.future_perturbation(
            s.clean, s.bounds.test, build, ["txn_id"], "txn_date", leakage.repeat_from).count()

    assert moved(real) == 0
    assert moved(leaky) == s.clean.where(F.col("txn_date") == F.lit(s.bounds.test)).count()
