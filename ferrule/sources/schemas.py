"""Fixed schemas of the decision-support tables (fixed values: public benchmark specification)."""

from __future__ import annotations

MONEY = "decimal(15,2)"

TABLES: dict[str, str] = {
    "part": f"p_partkey bigint, p_name string, p_mfgr string, p_brand string, p_type string, p_size int, p_container string, p_retailprice {MONEY}, p_comment string",
    "supplier": f"s_suppkey bigint, s_name string, s_address string, s_nationkey bigint, s_phone string, s_acctbal {MONEY}, s_comment string",
    "partsupp": f"ps_partkey bigint, ps_suppkey bigint, ps_availqty int, ps_supplycost {MONEY}, ps_comment string",
    "customer": f"c_custkey bigint, c_name string, c_address string, c_nationkey bigint, c_phone string, c_acctbal {MONEY}, c_mktsegment string, c_comment string",
    "orders": f"o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice {MONEY}, o_orderdate date, o_orderpriority string, o_clerk string, o_shippriority int, o_comment string",
    "lineitem": f"l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity {MONEY}, l_extendedprice {MONEY}, l_discount {MONEY}, l_tax {MONEY}, l_returnflag string, l_linestatus string, l_shipdate date, l_commitdate date, l_receiptdate date, l_shipinstruct string, l_shipmode string, l_comment string",
    "nation": "n_nationkey bigint, n_name string, n_regionkey bigint, n_comment string",
    "region": "r_regionkey bigint, r_name string, r_comment string",
}

#: Closes each line of a pipe-delimited file.
PLACEHOLDER = "__placeholder"


def table_schema(name: str, tbl: bool = False) -> str:
    """DDL of a table; with ``tbl`` the trailing empty column of pipe-delimited files is added."""
    if name not in TABLES:
        raise ValueError(f"no fixed schema for table {name!r}; known: {', '.join(sorted(TABLES))}")
    return TABLES[name] + (f", {PLACEHOLDER} string" if tbl else "")
