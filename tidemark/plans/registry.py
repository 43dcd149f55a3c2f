"""The registry of queries: a name, the Spark query, and the SQL over the same tables that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

#: SQL of the panel tables, as common table expressions.
CTES = {
    "ticks": "ticks AS (SELECT l_suppkey AS symbol, CAST(l_shipdate AS DATE) AS date, l_extendedprice / nullif(l_quantity, 0) AS price, l_quantity AS quantity, l_orderkey, l_linenumber, l_partkey, l_extendedprice, l_returnflag, l_discount, l_tax FROM lineitem WHERE l_quantity <> 0)",
    "bars": "bars AS (SELECT symbol, date, first(price ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice, quantity) AS open, max(price) AS high, min(price) AS low, last(price ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice, quantity) AS close, sum(quantity) AS volume FROM ticks GROUP BY symbol, date)",
    "rets": "rets AS (SELECT *, close / nullif(lag(close) OVER w, 0) - 1 AS ret FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY date))",
    "trades": "trades AS (SELECT user_id AS symbol, ts, event_id, value + 1 AS price, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS volume, CASE WHEN event_id % 2 = 0 THEN 1 ELSE -1 END AS side FROM events WHERE event_type = 'purchase')",
    "quotes": "quotes AS (SELECT user_id AS symbol, ts, event_id, value + 1 - 0.05 * (1 + CAST(json_extract_string(props, '$.k') AS DOUBLE) / 100) AS bid, value + 1 + 0.05 * (1 + CAST(json_extract_string(props, '$.k') AS DOUBLE) / 100) AS ask, CAST(event_id % 7 + 1 AS DOUBLE) AS bid_size, CAST(event_id % 5 + 1 AS DOUBLE) AS ask_size FROM events WHERE event_type = 'view')",
    "depth": "depth AS (SELECT user_id AS symbol, ts, level, (11 - level) * (1 + CAST(json_extract_string(props, '$.k') AS DOUBLE)) AS bid_size, CAST((11 - level) * (1 + event_id % 3) AS DOUBLE) AS ask_size FROM events, range(1, 11) AS r(level) WHERE event_type = 'view')",
    "mentions": "mentions AS (SELECT user_id AS symbol, ts, event_id, least(greatest((value - 50) / 50, -1.0), 1.0) AS sentiment, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS volume FROM events WHERE event_type = 'click')",
    "articles": "articles AS (SELECT doc_id AS id, doc_id % 100 AS symbol, DATE '1995-01-02' + CAST(doc_id % 2499 AS INTEGER) AS date, text AS title, source, n_chars FROM documents)",
    "headlines": "headlines AS (SELECT doc_id AS id, DATE '1995-01-02' + CAST(doc_id % 2499 AS INTEGER) AS date, text AS title, source FROM documents)",
    "disclosures": "disclosures AS (SELECT o_custkey % 100 AS symbol, o_custkey AS name, CAST(o_orderdate AS DATE) AS date, CAST(o_orderdate AS DATE) + 30 AS disclosed, CASE WHEN regexp_matches(o_orderpriority, '^[12]') THEN 'buy' WHEN regexp_matches(o_orderpriority, '^[45]') THEN 'sell' ELSE 'other' END AS kind, o_totalprice AS amount, o_orderkey FROM orders)",
    "sectors": "sectors AS (SELECT s_suppkey AS symbol, n_regionkey AS sector, s_nationkey AS industry FROM supplier JOIN nation ON s_nationkey = n_nationkey)",
    "fundamentals": "fundamentals AS (SELECT l_suppkey AS symbol, sum(l_extendedprice) AS revenue, sum(l_extendedprice * l_discount) AS debt, sum(l_extendedprice * l_tax) AS ebit, sum(l_quantity) AS shares, sum(CASE WHEN l_returnflag = 'R' THEN l_extendedprice ELSE 0.0 END) AS liabilities, avg(l_extendedprice) AS price, max(s_acctbal) AS cash FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY l_suppkey)",
}
NEEDS = {"bars": ["ticks"], "rets": ["ticks", "bars"]}


def sql(needs: str, text: str) -> str:
    """``text`` over the named panel tables; text may start with further expressions, each after a comma."""
    names = list(dict.fromkeys(x for n in needs.split() for x in [*NEEDS.get(n, []), n]))
    return f"WITH {', '.join(CTES[n] for n in names)} {text}"


def query(name: str, oracle: str | None = None) -> Callable[[Query], Query]:
    """Register a query; without an oracle it is checked against a small fixture in the tests."""

    def put(f: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = f
        if oracle:
            ORACLES[name] = oracle
        return f

    return put
