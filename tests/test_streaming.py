from pyspark.sql.types import StringType, StructField, StructType

from marketweek.streaming.weekly_increment import absorb_new_files, weekly_from_parts

SCHEMA = StructType([StructField(c, StringType()) for c in ("거래일자", "품목명", "반입량", "금액")])


def test_only_new_files_are_read_and_sums_add_up(spark, tmp_path):
    source, parts, memory = (str(tmp_path / n) for n in ("in", "parts", "memory"))
    (tmp_path / "in").mkdir()

    def arrive(name, *lines):
        text = "거래일자,품목명,반입량,금액\n" + "\n".join(lines) + "\n"
        (tmp_path / "in" / name).write_text(text, encoding="utf-8")
        absorb_new_files(spark, source, SCHEMA, parts, memory).awaitTermination()

    arrive("1.csv", "2024-01-01,a,1,10", "2024-01-02,b,1,5")
    arrive("2.csv", "2024-01-07,a,1,20", "2024-01-08,a,1,7")
    absorb_new_files(spark, source, SCHEMA, parts, memory).awaitTermination()  # nothing new
    got = {(r.item, str(r.week)): r.unit_price_week for r in weekly_from_parts(spark, parts).collect()}
    assert got == {("a", "2024-01-01"): 15.0, ("b", "2024-01-01"): 5.0, ("a", "2024-01-08"): 7.0}
