"""Domain tables as projections of the general test tables, once for Spark (SQL run by
Spark) and once for DuckDB. The two dialects share the text, but for a few functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..sources.files import spread

#: name -> (tables, SQL); {x} marks places where the dialects differ.
PROXIES = {
    "position": (
        ["lineitem"],
        """SELECT gene, pos, coverage, mutant, CASE WHEN coverage = 0 THEN NULL ELSE CAST(mutant AS DOUBLE) / coverage END AS mutrate
           FROM (SELECT concat('g', CAST(l_suppkey AS {string})) AS gene, l_partkey AS pos, CAST(sum(CAST(l_quantity AS BIGINT) * 20) AS BIGINT) AS coverage,
                   CAST(sum(CAST(floor(CAST(l_quantity AS BIGINT) * 20 * l_discount * 3) AS BIGINT)) AS BIGINT) AS mutant
                 FROM lineitem GROUP BY l_suppkey, l_partkey) p""",
    ),
    "cell_position": (
        ["lineitem"],
        """SELECT concat('g', CAST(l_suppkey AS {string})) AS gene, l_partkey AS pos, concat('c', CAST(l_linenumber AS {string})) AS cell,
             CAST(sum(CASE WHEN l_quantity > 3 THEN CAST(l_quantity AS BIGINT) * 20 END) AS BIGINT) AS dp,
             CAST(sum(CASE WHEN l_quantity > 3 THEN CAST(floor(CAST(l_quantity AS BIGINT) * 20 * l_discount * 3) AS BIGINT) END) AS BIGINT) AS ad
           FROM lineitem GROUP BY l_suppkey, l_partkey, l_linenumber""",
    ),
    "alignments": (
        ["lineitem"],
        """SELECT o * 10 + n AS ord, concat('r', CAST(o AS {string})) AS read_id, CAST(CASE WHEN n = 7 THEN 256 WHEN n = 6 THEN 2048 WHEN n = 5 THEN 16 ELSE 0 END AS INT) AS flag,
             CASE WHEN p % 17 <> 0 THEN concat('T', CAST(s % 10 AS {string})) END AS ref_name, CAST(q AS INT) AS ref_length
           FROM (SELECT l_orderkey AS o, l_linenumber AS n, max(l_partkey) AS p, max(l_suppkey) AS s, max(l_quantity) AS q FROM lineitem GROUP BY l_orderkey, l_linenumber) a""",
    ),
    "metadata": (["customer"], "SELECT concat('c', CAST(c_custkey AS {string})) AS cell, c_mktsegment AS leiden, c_acctbal AS n_windows, c_nationkey AS nation FROM customer"),
    "cell_window": (
        ["orders"],
        """SELECT concat('g', CAST(k % 20 AS {string})) AS gene, k % 50 AS win, concat('c', CAST(c AS {string})) AS cell, CAST(sum(CAST(floor(t / 100) AS BIGINT)) AS BIGINT) AS dp,
             max(CAST(CAST(floor(t) AS BIGINT) % 1000 AS DOUBLE)) / 2000 AS mr
           FROM (SELECT o_orderkey AS k, o_custkey AS c, floor(o_totalprice) AS t FROM orders) o GROUP BY k % 20, k % 50, c""",
    ),
    "sides": (
        ["lineitem"],
        """SELECT gene, pos, sample, side, coverage, CASE WHEN coverage % 13 <> 0 THEN CAST(mutant AS DOUBLE) / coverage END AS mutrate
           FROM (SELECT concat('g', CAST(l_suppkey % 20 AS {string})) AS gene, l_partkey % 200 AS pos, l_linestatus AS sample, l_returnflag AS side,
                   CAST(sum(CAST(l_quantity AS BIGINT) * 20) AS BIGINT) AS coverage, CAST(sum(CAST(floor(CAST(l_quantity AS BIGINT) * 20 * l_discount) AS BIGINT)) AS BIGINT) AS mutant
                 FROM lineitem GROUP BY l_suppkey % 20, l_partkey % 200, l_linestatus, l_returnflag) s""",
    ),
    "fastq": (
        ["events"],
        """SELECT event_id AS rec, concat('@', CAST(event_id AS {string})) AS header,
             substr(translate(concat(md5(CAST(event_id AS {string})), md5(concat('b', CAST(event_id AS {string}))), md5(concat('c', CAST(event_id AS {string})))), '0123456789abcdef', {letters}), 1, CAST(event_id % 97 AS INT)) AS quality,
             CASE WHEN event_id % 3 = 0 THEN 'DMSO' WHEN event_id % 3 = 1 THEN '2A3' END AS condition
           FROM events""",
    ),
    "names": (
        ["events"],
        """SELECT event_id AS ord, CASE WHEN event_id % 7 = 0 THEN concat(CAST(event_id AS {string}), '_', CAST(user_id AS {string}))
             WHEN event_id % 11 = 0 THEN concat(CAST(event_id AS {string}), '__', CAST(user_id AS {string}))
             ELSE concat(CAST(event_id AS {string}), ':x_', event_type, '_', CAST(user_id AS {string})) END AS read_id FROM events""",
    ),
    "runs": (
        ["customer"],
        """SELECT concat('d', CAST(c_custkey AS {string})) AS directory, 's' AS stem, concat('s', CAST(c_custkey % 4 AS {string})) AS sensitivity, concat('m', CAST(c_custkey % 2 AS {string})) AS mp,
             concat('d', CAST(c_nationkey % 2 AS {string})) AS rdg, concat('f', CAST(c_nationkey % 3 AS {string})) AS rfg, c_acctbal AS overall_rate,
             CASE WHEN c_custkey % 5 <> 0 THEN c_acctbal / 2 END AS exact_rate, CAST(c_custkey % 101 AS DOUBLE) AS multiple_rate FROM customer""",
    ),
    "lengths": (["lineitem"], "SELECT CAST(l_quantity AS BIGINT) AS length, CAST(count(*) AS BIGINT) AS n FROM lineitem GROUP BY 1"),
    "files": (
        ["events"],
        """SELECT CASE WHEN event_id % 3 = 0 THEN 'DMSO' WHEN event_id % 3 = 1 THEN '2A3' END AS condition, CASE WHEN event_id % 4 = 0 THEN 'fail' ELSE 'pass' END AS verdict,
             user_id * 1000 AS n_bytes, event_id * 4 AS n_lines FROM events""",
    ),
}
#: What tables are spread by before groups as many as their rows are made of them.
SPREAD = {"position": ("l_suppkey", "l_partkey"), "cell_position": ("l_suppkey", "l_partkey")}
LETTERS = "!+5:?DI#%&)-/147"


def sql_of(name: str) -> str:
    """DuckDB SQL of a proxy."""
    return PROXIES[name][1].replace("{string}", "VARCHAR").replace("{letters}", f"'{LETTERS}'").replace("AS INT)", "AS INTEGER)")


def proxy(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The proxy as a DataFrame; the tables come in as SQL parameters, not as views."""
    tables, sql = PROXIES[name]
    text = sql.replace("{string}", "STRING").replace("{letters}", f"'{LETTERS}'")
    for t in tables:
        text = text.replace(f"FROM {t}", f"FROM {{{t}}}")
    read = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in tables}
    if name in SPREAD:
        read = {t: spread(df, *SPREAD[name]) for t, df in read.items()}
    return spark.sql(text, **read)


def with_proxies(sql: str, *names: str) -> str:
    """DuckDB SQL with the proxies as common table expressions before the others."""
    head = ", ".join(f"{n} AS ({sql_of(n)})" for n in names)
    return f"WITH {head}" + (f", {sql.lstrip()[5:]}" if sql.lstrip().upper().startswith("WITH ") else f" {sql}")
