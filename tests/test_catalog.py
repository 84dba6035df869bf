import os

import duckdb
import pytest
from framebasin.plans import catalog

SF = "/root/testdata/sf0.001"
NAMES = (
    "top_n_per_source split_fps route_groups composition dup_report strict_dedup pair_min_distance coordination "
    "unwrap_msd parity fit_element_energy band_edges validate_frames"
).split()


def test_every_sql_belongs_to_a_query():
    assert set(catalog.ORACLES) <= set(catalog.QUERIES)
    assert set(catalog.QUERIES) - set(catalog.ORACLES) == {"rdf_spline_minimum"}


@pytest.mark.skipif(not os.path.isdir(SF), reason="supplied tables are absent")
@pytest.mark.parametrize("name", NAMES)
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    cur = con.execute(catalog.ORACLES[name])
    cols = [d[0] for d in cur.description]
    want = sorted((tuple(r[cols.index(c)] for c in sorted(cols)) for r in cur.fetchall()), key=repr)
    df = catalog.QUERIES[name](spark, SF)
    assert sorted(df.columns) == sorted(cols)
    got = sorted((tuple(r[c] for c in sorted(cols)) for r in df.collect()), key=repr)
    assert got == want
