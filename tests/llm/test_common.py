import zlib

from runweave.llm import common


def test_cut_tables_stay_until_they_are_dropped(spark):
    df = common.cut(spark.createDataFrame([(1, "a"), (2, None)], "x long, y string"), "mine")
    assert sorted(map(tuple, df.collect())) == [(1, "a"), (2, None)] and common.shared_dir(spark) in df.inputFiles()[0]
    again = common.cut(df, "mine")
    assert again.inputFiles() != df.inputFiles()


def test_fold_is_crc32_of_the_text(spark):
    got = spark.createDataFrame([(0,), (7,), (-3,), (None,)], "doc_id long").select("doc_id", common.fold("doc_id", 5).alias("f")).collect()
    assert {r["doc_id"]: r["f"] for r in got} == {d: zlib.crc32(b"" if d is None else str(d).encode()) % 5 for d in (0, 7, -3, None)}


def test_names_and_tokens(spark):
    df = spark.createDataFrame([(1, 2)], "A int, a_ int")
    assert common.free_name(df, "a") == "a__" and common.replaces(df, ["a"]).columns == ["a_"]
    assert common.tokens("ÀB  c\x0bD\xa0e\x85f") == ["Àb".encode(), b"c", "d\xa0e\x85f".encode()] and common.tokens(None) == []
