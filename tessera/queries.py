"""One registered query for each operator of the dialect, with its DuckDB counterpart.

Text in the dialect goes through the engine's front end to a lazy DataFrame; columns are named by position.
Sums of money go through exact decimals in the oracle and are compared as doubles rounded alike.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera import scenarios
from tessera.operators.relational import explain, select
from tessera.plans.grammar import parse
from tessera.sources.external import ParquetFolder


@dataclass(frozen=True)
class Query:
    text: str
    names: tuple[str, ...]
    sql: str
    parameters: tuple = ()
    rounded: tuple[str, ...] = ()  # doubles summed in an order of their own
    ordered: bool = False
    floats: tuple[str, ...] = ()  # integers with nulls, which data frames of the oracle's side may hold as either

    def __call__(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        planned = select(parse(self.text, self.parameters), ParquetFolder(spark, sf_dir), ordered=self.ordered)
        df = planned.df.toDF(*self.names)
        for name in self.rounded:
            df = df.withColumn(name, F.round(name, 2))
        for name in self.floats:
            df = df.withColumn(name, F.col(name).cast("double"))
        return df


def _q(text: str, names: str, sql: str, **more) -> Query:
    return Query(" ".join(text.split()), tuple(names.split()), sql, **more)


FLAGSHIP = _q(
    """SELECT c_mktsegment, COUNT(*), SUM(o_totalprice), AVG(o_totalprice) FROM orders JOIN customer ON orders.o_custkey = customer.c_custkey
       WHERE o_totalprice >= 1000 GROUP BY c_mktsegment HAVING COUNT(*) > 10 ORDER BY COUNT(*) DESC""",
    "segment n total mean",
    """SELECT c_mktsegment AS segment, count(*) AS n, round(CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE), 2) AS total, round(avg(o_totalprice), 2) AS mean
       FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_totalprice >= 1000 GROUP BY c_mktsegment HAVING count(*) > 10""",
    rounded=("total", "mean"),
)

CATALOGUE: dict[str, Query] = {
    "flagship": FLAGSHIP,
    "scan_all": _q("SELECT * FROM nation", "n_nationkey n_name n_regionkey", "SELECT * FROM nation"),
    "project_cols": _q("SELECT c_custkey, c_name, c_mktsegment FROM customer", "c_custkey c_name c_mktsegment", "SELECT c_custkey, c_name, c_mktsegment FROM customer"),
    "project_qualified": _q("SELECT nation.n_name, n_regionkey FROM nation", "n_name n_regionkey", "SELECT n_name, n_regionkey FROM nation"),
    "pk_seek": _q("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey = 77", "o_orderkey o_totalprice", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey = 77"),
    "pk_range": _q(
        "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderkey > 100 AND o_orderkey <= 300", "o_orderkey o_orderstatus",
        "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderkey > 100 AND o_orderkey <= 300",
    ),
    "pk_open_range": _q("SELECT c_custkey FROM customer WHERE c_custkey >= 90", "c_custkey", "SELECT c_custkey FROM customer WHERE c_custkey >= 90"),
    "filter_eq_text": _q("SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F'", "o_orderkey", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F'"),
    "filter_ne": _q("SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'F' AND o_custkey != 7", "o_orderkey", "SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'F' AND o_custkey <> 7"),
    "filter_lt_le_gt_ge": _q(
        "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity >= 10 AND l_quantity < 12.5 AND l_discount > 0.02 AND l_tax <= 0.06",
        "l_orderkey l_linenumber l_quantity",
        "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity >= 10 AND l_quantity < 12.5 AND l_discount > 0.02::DOUBLE AND l_tax <= 0.06::DOUBLE",
    ),
    "filter_col_col": _q(
        "SELECT l_orderkey, l_discount, l_tax FROM lineitem WHERE l_discount > l_tax", "l_orderkey l_discount l_tax", "SELECT l_orderkey, l_discount, l_tax FROM lineitem WHERE l_discount > l_tax"
    ),
    "filter_and_or_not": _q(
        "SELECT o_orderkey FROM orders WHERE (o_orderstatus = 'F' OR o_totalprice > 200000) AND NOT (o_custkey < 50 OR o_orderpriority = '1-URGENT')",
        "o_orderkey",
        "SELECT o_orderkey FROM orders WHERE (o_orderstatus = 'F' OR o_totalprice > 200000) AND NOT (o_custkey < 50 OR o_orderpriority = '1-URGENT')",
    ),
    "filter_3vl_null": _q(
        "SELECT documents.doc_id FROM documents LEFT JOIN labels ON documents.doc_id = labels.doc_id WHERE NOT (quality = 1)", "doc_id",
        "SELECT d.doc_id FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id WHERE NOT (quality = 1)",
    ),
    "filter_null_literal": _q("SELECT n_nationkey FROM nation WHERE n_nationkey = NULL OR n_regionkey = 1", "n_nationkey", "SELECT n_nationkey FROM nation WHERE n_nationkey = NULL OR n_regionkey = 1"),
    "filter_type_mismatch": _q("SELECT n_nationkey FROM nation WHERE n_nationkey != 'x' AND NOT (n_name = 3)", "n_nationkey", "SELECT n_nationkey FROM nation"),
    "filter_bool_literal": _q("SELECT doc_id FROM labels WHERE toxic = TRUE", "doc_id", "SELECT doc_id FROM labels WHERE toxic = 1"),
    "filter_literal_left": _q("SELECT o_orderkey FROM orders WHERE 250000.0 <= o_totalprice", "o_orderkey", "SELECT o_orderkey FROM orders WHERE 250000.0::DOUBLE <= o_totalprice"),
    "inner_join_equi": _q(
        "SELECT o_orderkey, c_name FROM orders JOIN customer ON orders.o_custkey = customer.c_custkey", "o_orderkey c_name", "SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey"
    ),
    "join_chain4": _q(
        """SELECT r_name, COUNT(*) FROM region JOIN nation ON nation.n_regionkey = region.r_regionkey JOIN customer ON customer.c_nationkey = nation.n_nationkey
           JOIN orders ON orders.o_custkey = customer.c_custkey GROUP BY r_name""",
        "r_name n",
        "SELECT r_name, count(*) AS n FROM region JOIN nation ON n_regionkey = r_regionkey JOIN customer ON c_nationkey = n_nationkey JOIN orders ON o_custkey = c_custkey GROUP BY r_name",
    ),
    "left_join_nulls": _q(
        "SELECT documents.doc_id, quality FROM documents LEFT OUTER JOIN labels ON documents.doc_id = labels.doc_id", "doc_id quality",
        "SELECT d.doc_id, quality::DOUBLE AS quality FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id", floats=("quality",),
    ),
    "theta_join": _q("SELECT n_name, r_name FROM nation JOIN region ON nation.n_regionkey < region.r_regionkey", "n_name r_name", "SELECT n_name, r_name FROM nation JOIN region ON n_regionkey < r_regionkey"),
    "theta_left_join": _q("SELECT r_name, n_name FROM region LEFT JOIN nation ON nation.n_nationkey > region.r_regionkey AND n_nationkey < 3", "r_name n_name",
                          "SELECT r_name, n_name FROM region LEFT JOIN nation ON n_nationkey > r_regionkey AND n_nationkey < 3"),
    "join_mixed_on": _q(
        "SELECT o_orderkey, c_custkey FROM orders JOIN customer ON orders.o_custkey = customer.c_custkey AND customer.c_acctbal > 5000", "o_orderkey c_custkey",
        "SELECT o_orderkey, c_custkey FROM orders JOIN customer ON o_custkey = c_custkey AND c_acctbal > 5000",
    ),
    "left_join_mixed_on": _q(
        "SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON orders.o_custkey = customer.c_custkey AND orders.o_totalprice > 300000", "c_custkey o_orderkey",
        "SELECT c_custkey, o_orderkey::DOUBLE AS o_orderkey FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_totalprice > 300000", floats=("o_orderkey",),
    ),
    "cartesian": _q("SELECT r_name, n_name FROM region JOIN nation ON 1 = 1", "r_name n_name", "SELECT r_name, n_name FROM region CROSS JOIN nation"),
    "table_star_join": _q(
        "SELECT customer.* FROM customer JOIN nation ON customer.c_nationkey = nation.n_nationkey WHERE n_name > 'M'", "c_custkey c_name c_nationkey c_acctbal c_mktsegment",
        "SELECT customer.* FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_name > 'M'",
    ),
    "agg_global": _q(
        "SELECT COUNT(*), SUM(l_linenumber), MIN(l_quantity), MAX(l_quantity) FROM lineitem", "n total low high",
        "SELECT count(*) AS n, CAST(sum(l_linenumber) AS BIGINT) AS total, min(l_quantity) AS low, max(l_quantity) AS high FROM lineitem",
    ),
    "agg_empty_input": _q(
        "SELECT COUNT(*), SUM(o_custkey), AVG(o_custkey), MIN(o_orderstatus) FROM orders WHERE o_orderkey < 0", "n total mean low",
        "SELECT count(*) AS n, CAST(sum(o_custkey) AS BIGINT) AS total, avg(o_custkey) AS mean, min(o_orderstatus) AS low FROM orders WHERE o_orderkey < 0",
    ),
    "group_one": _q(
        "SELECT l_returnflag, COUNT(*), SUM(l_extendedprice) FROM lineitem GROUP BY l_returnflag", "flag n total",
        "SELECT l_returnflag AS flag, count(*) AS n, round(CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE), 2) AS total FROM lineitem GROUP BY l_returnflag",
        rounded=("total",),
    ),
    "group_two": _q(
        "SELECT l_returnflag, l_linestatus, COUNT(*), AVG(l_linenumber) FROM lineitem GROUP BY l_returnflag, lineitem.l_linestatus", "flag status n mean",
        "SELECT l_returnflag AS flag, l_linestatus AS status, count(*) AS n, round(avg(l_linenumber), 2) AS mean FROM lineitem GROUP BY l_returnflag, l_linestatus",
        rounded=("mean",),
    ),
    "group_null_key": _q(
        "SELECT quality, COUNT(*) FROM documents LEFT JOIN labels ON documents.doc_id = labels.doc_id GROUP BY quality", "quality n",
        "SELECT quality::DOUBLE AS quality, count(*) AS n FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id GROUP BY quality", floats=("quality",),
    ),
    "count_col_vs_star": _q(
        "SELECT COUNT(*), COUNT(quality) FROM documents LEFT JOIN labels ON documents.doc_id = labels.doc_id", "n filled",
        "SELECT count(*) AS n, count(quality) AS filled FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id",
    ),
    "min_max_text": _q("SELECT MIN(o_orderpriority), MAX(o_orderpriority) FROM orders", "low high", "SELECT min(o_orderpriority) AS low, max(o_orderpriority) AS high FROM orders"),
    "avg_int": _q("SELECT o_orderstatus, AVG(o_custkey) FROM orders GROUP BY o_orderstatus", "status mean", "SELECT o_orderstatus AS status, round(avg(o_custkey), 2) AS mean FROM orders GROUP BY o_orderstatus", rounded=("mean",)),
    "having_agg": _q(
        "SELECT c_nationkey, COUNT(*) FROM customer GROUP BY c_nationkey HAVING COUNT(*) >= 60 AND c_nationkey > 3", "nation n",
        "SELECT c_nationkey AS nation, count(*) AS n FROM customer GROUP BY c_nationkey HAVING count(*) >= 60 AND c_nationkey > 3",
    ),
    "having_no_group": _q("SELECT COUNT(*) FROM orders HAVING COUNT(*) > 5", "n", "SELECT count(*) AS n FROM orders HAVING count(*) > 5"),
    "having_hidden_agg": _q(
        "SELECT c_mktsegment FROM customer GROUP BY c_mktsegment HAVING MAX(c_acctbal) > 9000", "segment", "SELECT c_mktsegment AS segment FROM customer GROUP BY c_mktsegment HAVING max(c_acctbal) > 9000"
    ),
    "order_asc_nulls": _q(
        "SELECT documents.doc_id, quality FROM documents LEFT JOIN labels ON documents.doc_id = labels.doc_id ORDER BY quality", "doc_id quality",
        "SELECT d.doc_id, quality::DOUBLE AS quality FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id ORDER BY quality ASC NULLS LAST, d.doc_id", ordered=True, floats=("quality",),
    ),
    "order_desc_nulls": _q(
        "SELECT documents.doc_id, quality FROM documents LEFT JOIN labels ON documents.doc_id = labels.doc_id ORDER BY quality DESC", "doc_id quality",
        "SELECT d.doc_id, quality::DOUBLE AS quality FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id ORDER BY quality DESC NULLS FIRST, d.doc_id", ordered=True, floats=("quality",),
    ),
    "order_hidden": _q("SELECT c_name FROM customer ORDER BY c_acctbal DESC", "c_name", "SELECT c_name FROM customer ORDER BY c_acctbal DESC NULLS FIRST, c_custkey", ordered=True),
    "order_by_agg": _q(
        "SELECT c_nationkey FROM customer GROUP BY c_nationkey ORDER BY COUNT(*) DESC", "nation",
        "SELECT c_nationkey AS nation FROM customer GROUP BY c_nationkey ORDER BY count(*) DESC, min(c_custkey)", ordered=True,
    ),
    "topk": _q("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC LIMIT 10", "o_orderkey o_totalprice", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10"),
    "limit_by_pk": _q("SELECT event_id, event_type FROM events LIMIT 40", "event_id event_type", "SELECT event_id, event_type FROM events ORDER BY event_id LIMIT 40"),
    "params_bound": _q(
        "SELECT o_orderkey FROM orders WHERE o_orderstatus = ? AND o_totalprice > ? AND o_custkey != ?", "o_orderkey",
        "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P' AND o_totalprice > 100000.5::DOUBLE AND o_custkey <> 11", parameters=("P", 100000.5, 11),
    ),
    "soft_keyword_column": _q("SELECT role, COUNT(text) FROM conversations GROUP BY role", "role n", "SELECT role, count(text) AS n FROM conversations GROUP BY role"),
}


def explain_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """EXPLAIN lines of a seek, a range, a scan and a join."""
    tables, lines = ParquetFolder(spark, sf_dir), []
    for i, text in enumerate((
        "SELECT * FROM orders WHERE o_orderkey = 5", "SELECT * FROM orders WHERE o_orderkey > 5 AND o_orderkey < 10", "SELECT * FROM orders WHERE o_orderstatus = 'F'",
        "SELECT * FROM orders JOIN customer ON orders.o_custkey = customer.c_custkey",
    )):
        lines += [(i, k, line) for k, line in enumerate(explain(parse(text), tables))]
    return spark.createDataFrame(lines, "query int, line int, plan string")


EXPLAIN_SQL = """
SELECT * FROM (VALUES (0, 0, 'Index Seek on orders_pkey (o_orderkey = 5)'), (1, 0, 'Index Range Scan on orders_pkey (6 <= o_orderkey <= 9)'),
  (2, 0, 'Seq Scan on orders  [filter]'), (3, 0, 'Nested Loop Join'), (3, 1, '  -> Seq Scan on orders'),
  (3, 2, '  -> INNER Join  Index Seek on customer_pkey (customer.c_custkey = outer) [per outer row]')) t(query, line, plan)
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {**CATALOGUE, "explain_paths": explain_paths, **scenarios.QUERIES}


def oracle_sql() -> dict[str, str]:
    return {**{k: q.sql for k, q in CATALOGUE.items()}, "explain_paths": EXPLAIN_SQL, **scenarios.ORACLE}
