import duckdb
import pytest

import __spark_entry__ as entry
from wirelark.plans import layers

SF = "/root/testdata/sf0.001"
NAMES = "flow_tcp_state flow_stats ipv4_header_checksum cidr_math frame_roundtrip_arp pcapng_roundtrip bpf_net_or ipv4_fragment_reassemble tcp_reassembly answers_tcp arp_neighbor_asof cidr_route_lpm dns_answer_parse custom_proto_roundtrip traffic_rollup anon_ports crc16_families hexdump".split() + list(layers.QUERIES)


def rows(df):
    df = df[sorted(df.columns)]
    return sorted(tuple("" if v is None or v != v else str(int(v)) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v) for v in r) for r in df.astype(object).where(df.notna(), None).itertuples(index=False, name=None))


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.execute("SET TimeZone='UTC'")
    for t in "nation customer orders lineitem events documents pages conversations benchmark".split():
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def test_registry():
    q, o = entry.queries(), entry.oracle_sql()
    assert set(o) <= set(q) and len(q) > 80


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, duck, name):
    got, want = entry.queries()[name](spark, SF).toPandas(), duck.sql(entry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and rows(got) == rows(want)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
