"""Half-precision numbers over every pattern of 16 bits, against the SQL."""

import duckdb

from sondage.plans import catalog


def test_every_pattern_of_bits_equals_the_sql(spark, tmp_path):
    """The bits of key 32768 are the negative zero of the upper halves, those of key 65536 the positive one."""
    c = duckdb.connect()
    c.execute(f"copy (select range as p_partkey from range(1, 65537)) to '{tmp_path}/part.parquet' (format parquet)")
    c.execute(f"create view part as select * from '{tmp_path}/part.parquet'")
    want = {p: (h, b) for p, h, b in c.execute(catalog.ORACLE["p12_half_decode"]).fetchall()}
    got = {r["part"]: (r["half"], r["brain"]) for r in catalog.QUERIES["p12_half_decode"](spark, str(tmp_path)).collect()}
    assert len(want) == 65536 and got == want
