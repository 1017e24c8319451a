"""The engine's queries over the TPC-H-like tables, each with SQL that DuckDB answers alike.

An entry is (query of this engine, SQL); None for the SQL where the texts are the same.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orweave.engine import Config, Engine
from orweave.functions.expressions import Settings
from orweave.plans.planners import PLANNERS

JOINS = "c_custkey = o_custkey and o_orderkey = l_orderkey"
CLAUSES = ["c_acctbal < 500 and l_quantity < 5", "c_mktsegment = 'BUILDING' and l_discount < 0.02", "o_totalprice < 20000 and l_tax < 0.02"]
TOTALS = "select min(c_custkey) as a, min(o_orderkey) as b, count(1) as n from customer, orders, lineitem where"
DNF = f"{TOTALS} {JOINS} and ({' or '.join(f'({c})' for c in CLAUSES)})"
CNF = f"{TOTALS} {JOINS} and (c_acctbal < 500 or l_quantity < 5) and (c_mktsegment = 'BUILDING' or l_discount < 0.02) and o_totalprice < 200000"
DUPLICATE = "select count(1) as n from orders, lineitem where o_orderkey = l_orderkey and (o_totalprice < 50000 or l_quantity < 5) and (l_discount < 0.02 or (l_tax < 0.03 and (o_totalprice < 50000 or l_quantity < 5)))"
#: Seven tables, cyclic edges, LIKE, IN, BETWEEN and IS NULL under one OR, as in join-order benchmarks.
WIDE = """select min(r_name) as region, min(p_name) as part, min(s_name) as supplier, count(*) as n
from region r, nation n, customer c, supplier s, orders o, lineitem l, part p
where r.r_regionkey = n.n_regionkey and n.n_nationkey = c.c_nationkey and n.n_nationkey = s.s_nationkey and c.c_nationkey = s.s_nationkey
  and c.c_custkey = o.o_custkey and o.o_orderkey = l.l_orderkey and s.s_suppkey = l.l_suppkey and p.p_partkey = l.l_partkey
  and ((p.p_name like '%a%' and o.o_orderpriority in ('1-URGENT', '2-HIGH')) or (p.p_size between 10 and 20 and c.c_mktsegment != 'BUILDING' and l.l_tax < 0.05)
    or (not (r.r_regionkey < 3 or l.l_quantity >= 10) and o.o_orderstatus is not null))"""

#: Groups of queries of one join shape, as join-order benchmarks have them: outputs, tables, joins and what each query asks besides.
GROUPS = {
    "suppliers": (
        "select min(s_name) as supplier, min(p_name) as part, count(*) as n from nation n, supplier s, lineitem l, part p",
        "n.n_nationkey = s.s_nationkey and s.s_suppkey = l.l_suppkey and p.p_partkey = l.l_partkey",
        ["p.p_size < 10 and n.n_name like '%1%'", "p.p_size < 10 and l.l_discount > 0.08 and s.s_acctbal < 0", "p.p_size < 10 and (p.p_name like '%b%' or l.l_quantity between 40 and 45) and l.l_tax = 0.01"],
    ),
    "customers": (
        "select min(c_name) as customer, max(o_orderdate) as latest, count(*) as n from region r, nation n, customer c, orders o",
        "r.r_regionkey = n.n_regionkey and n.n_nationkey = c.c_nationkey and c.c_custkey = o.o_custkey",
        ["o.o_orderpriority in ('1-URGENT') and c.c_mktsegment != 'BUILDING'", "r.r_regionkey = 2 and (c.c_acctbal < 0 or o.o_totalprice > 300000)", "not (c.c_acctbal > 100 or r.r_regionkey > 1)", "o.o_orderstatus = 'P' and n.n_name like 'NATION__'"],
    ),
    "returns": (
        "select min(o_orderkey) as first, sum(l_quantity) as quantity, count(*) as n from customer c, orders o, lineitem l",
        "c.c_custkey = o.o_custkey and o.o_orderkey = l.l_orderkey",
        ["l.l_returnflag = 'R' and c.c_acctbal < 200", "l.l_returnflag = 'R' and o.o_totalprice < 30000", "l.l_returnflag = 'R' and l.l_shipdate < '1996-01-01' and c.c_mktsegment = 'BUILDING'"],
    ),
}

QUERIES: dict[str, tuple[str, str | None]] = {
    "scan_project": ("select c_custkey, c_name, c_acctbal from customer", None),
    "select_star": ("select * from region", None),
    "qualified_star": ("select n.* from nation n, region r where n.n_regionkey = r.r_regionkey and r.r_regionkey < 2", None),
    "literals": ("select n_name, 1 as i, 2.5 as d, 'x' as s, true as b from nation", "select n_name, 1 as i, cast(2.5 as double) as d, 'x' as s, true as b from nation"),
    "arith_add_sub_mul": ("select l_orderkey, l_linenumber, l_extendedprice + l_tax as a, l_extendedprice - l_tax as s, l_quantity * l_discount as m from lineitem", None),
    "arith_int_add_promotes": ("select n_nationkey, n_nationkey + 1 as p from nation", "select n_nationkey, cast(n_nationkey as bigint) + 1 as p from nation"),
    "arith_div_double": ("select p_partkey, p_retailprice / 4 as q from part", None),
    "arith_div_int": ("select o_orderkey, o_orderkey / 7 as q from orders", "select o_orderkey, cast(o_orderkey // 7 as bigint) as q from orders"),
    "arith_div_big": ("select n_nationkey, (n_nationkey + 9007199254740993) / 1 as q, (9007199254740993 - n_nationkey) / 3 as t from nation", "select n_nationkey, cast(n_nationkey as bigint) + 9007199254740993 as q, (9007199254740993 - cast(n_nationkey as bigint)) // 3 as t from nation"),
    "arith_mod": ("select o_orderkey, o_orderkey % 7 as r from orders", "select o_orderkey, cast(o_orderkey % 7 as bigint) as r from orders"),
    "unary_minus": ("select c_custkey, -c_acctbal as neg from customer", None),
    "neg_literal": ("select c_custkey from customer where c_acctbal < -100", None),
    "str_concat": ("select n_nationkey, n_name + '_x' as s from nation", "select n_nationkey, n_name || '_x' as s from nation"),
    "cmp_lt": ("select l_orderkey, l_linenumber from lineitem where l_quantity < 5", None),
    "cmp_lteq": ("select l_orderkey, l_linenumber from lineitem where l_quantity <= 5", None),
    "cmp_gt_flipped": ("select l_orderkey, l_linenumber from lineitem where l_quantity > 45", None),
    "cmp_gteq_flipped": ("select l_orderkey, l_linenumber from lineitem where l_quantity >= 45", None),
    "cmp_eq_str": ("select c_custkey from customer where c_mktsegment = 'BUILDING'", None),
    "cmp_noteq": ("select c_custkey from customer where c_mktsegment != 'BUILDING'", None),
    "cmp_str_order": ("select n_nationkey from nation where n_name < 'NATION_15'", None),
    "cmp_col_col_same_table": ("select l_orderkey, l_linenumber from lineitem where l_tax < l_discount", None),
    "cmp_datetime_str": ("select o_orderkey from orders where o_orderdate < '1997-01-01'", "select o_orderkey from orders where o_orderdate < timestamp '1997-01-01 00:00:00'"),
    "cmp_datetime_str_flipped": ("select o_orderkey from orders where o_orderdate > '2000-01-01T00:00:00Z'", "select o_orderkey from orders where o_orderdate > timestamp '2000-01-01 00:00:00'"),
    "datetime_plus_interval": ("select o_orderkey, o_orderdate + '1 day' as d from orders", "select o_orderkey, o_orderdate + interval '1' day as d from orders"),
    "datetime_minus_interval": ("select o_orderkey, o_orderdate - interval '7' day as d from orders", None),
    "interval_month_is_30_days": ("select o_orderkey, o_orderdate + '2 months' as d from orders", "select o_orderkey, o_orderdate + interval '60' day as d from orders"),
    "not_atom": ("select c_custkey from customer where not (c_acctbal < 500)", None),
    "not_tree": ("select c_custkey from customer where not (c_acctbal < 500 or c_mktsegment = 'BUILDING' and not c_nationkey in (1, 2, 3))", None),
    "constant_filter": ("select c_custkey from customer where true and c_acctbal < 0", None),
    "is_null": ("select count(1) as n from customer where nullif(c_mktsegment, 'BUILDING') is null", None),
    "is_not_null": ("select count(1) as n from customer where nullif(c_mktsegment, 'BUILDING') is not null", None),
    "between_num": ("select p_partkey from part where p_size between 10 and 20", None),
    "not_between": ("select p_partkey from part where p_size not between 10 and 20", None),
    "between_str": ("select n_nationkey from nation where n_name between 'NATION_10' and 'NATION_15'", None),
    "between_double": ("select c_custkey from customer where c_acctbal between 100.5 and 900.5", None),
    "in_list_str": ("select o_orderkey from orders where o_orderpriority in ('1-URGENT', '2-HIGH')", None),
    "not_in_list_str": ("select o_orderkey from orders where o_orderpriority not in ('1-URGENT', '2-HIGH')", None),
    "in_list_int": ("select p_partkey from part where p_size in (1, 5, 9)", None),
    "in_list_double": ("select l_orderkey, l_linenumber from lineitem where l_discount in (0.01, 0.05)", None),
    "like": ("select p_partkey from part where p_name like '%widget%'", None),
    "not_like": ("select p_partkey from part where p_name not like '%widget%'", None),
    "like_underscore": ("select n_nationkey from nation where n_name like 'NATION__'", None),
    "like_backslash": ("select n_nationkey from nation where n_name + '\\' like 'NATION\\_1_\\' or n_name + '\\x' like '%_1\\_'", "select n_nationkey from nation where n_name || '\\' like 'NATION\\_1_\\' or n_name || '\\x' like '%_1\\_'"),
    "and_filter": ("select l_orderkey, l_linenumber from lineitem where l_quantity < 10 and l_discount < 0.05 and l_tax < 0.04", None),
    "or_filter": ("select l_orderkey, l_linenumber from lineitem where l_quantity < 3 or l_discount < 0.01 or l_tax < 0.01", None),
    "nested_bool": ("select l_orderkey, l_linenumber from lineitem where l_quantity < 10 and (l_discount < 0.02 or (l_tax < 0.02 and l_returnflag = 'A'))", None),
    "join_long": ("select o_orderkey, c_name from orders, customer where o_custkey = c_custkey", None),
    "join_int": ("select n_name, r_name from nation, region where n_regionkey = r_regionkey", None),
    "join_str": ("select a.n_nationkey as x, b.n_nationkey as y from nation a, nation b where a.n_name = b.n_name", None),
    "self_join": ("select a.s_suppkey as x, b.s_suppkey as y from supplier a, supplier b where a.s_nationkey = b.s_nationkey", None),
    "join_chain": ("select min(c_custkey) as a, min(l_linenumber) as b, count(1) as n from customer, orders, lineitem where c_custkey = o_custkey and o_orderkey = l_orderkey and o_orderstatus = 'F'", None),
    "join_cyclic_redundant": ("select count(1) as n from customer c, supplier s, nation n where c.c_nationkey = n.n_nationkey and s.s_nationkey = n.n_nationkey and c.c_nationkey = s.s_nationkey", None),
    "join_composite_key": ("select count(1) as n from lineitem a, lineitem b where a.l_orderkey = b.l_orderkey and a.l_linenumber = b.l_linenumber", None),
    "agg_sum_int": ("select sum(p_size) as s from part", "select cast(sum(p_size) as bigint) as s from part"),
    "agg_sum_double": ("select round(sum(c_acctbal), 2) as s from customer", None),
    "agg_min_max_num": ("select min(o_totalprice) as lo, max(o_totalprice) as hi, min(o_orderkey) as k from orders", None),
    "agg_min_str": ("select min(p_name) as m from part", None),
    "agg_avg_int_trunc": ("select avg_trunc(p_size) as a from part", "select cast(sum(p_size) // count(p_size) as bigint) as a from part"),
    "agg_avg_big": ("select avg_trunc(n_nationkey + 9007199254740993) as a from nation", "select cast(sum(cast(n_nationkey as bigint) + 9007199254740993) // count(*) as bigint) as a from nation"),
    "agg_avg_double": ("select round(avg(c_acctbal), 4) as a from customer", None),
    "agg_count": ("select count(o_orderkey) as n from orders", None),
    "agg_count_star": ("select count(*) as n from lineitem where l_quantity < 5 or l_tax < 0.01", None),
    "agg_multi": ("select min(c_name) as a, min(n_name) as b, count(c_custkey) as n from customer, nation where c_nationkey = n_nationkey and (c_acctbal < 0 or n_name like '%1%')", None),
    "agg_empty": ("select min(c_name) as a, sum(c_acctbal) as s, count(c_custkey) as n from customer where c_custkey < -1", None),
    "group_by_ext": ("select o_orderstatus, count(1) as n, min(o_totalprice) as lo from orders group by o_orderstatus", None),
    "group_by_expression": ("select o_orderkey % 5 as k, count(*) + 1 as n from orders, customer where o_custkey = c_custkey and (c_acctbal < 0 or o_totalprice < 30000) group by o_orderkey % 5", None),
}
PLANNED = {"dnf": DNF, "cnf": CNF, "dup_atom": DUPLICATE, "wide": WIDE}
SPECS = {
    "dnf": {frozenset({"customer", "orders"}): ["orders.o_totalprice < 20000"]},
    "cnf": {frozenset({"customer", "orders", "lineitem"}): ["lineitem.l_quantity < 5"]},
    "dup_atom": {frozenset({"orders", "lineitem"}): ["lineitem.l_tax < 0.03"]},
    "wide": {frozenset("rncsolp"): ["l.l_tax < 0.05"]},
}
_engines: dict[tuple[str, str, Config], Engine] = {}


def engine(spark: SparkSession, sf_dir: str, config: Config = Config()) -> Engine:
    """An engine for the folder; kept, so that its statistics are gathered once. Those of ended applications go."""
    app = f"{spark.sparkContext.applicationId} {spark._jsparkSession.hashCode()}"
    for old in [k for k in _engines if k[0].split()[0] != app.split()[0]]:
        del _engines[old]
    key = app, sf_dir, config
    if key not in _engines:
        _engines[key] = Engine(spark, sf_dir, config)
    return _engines[key]


def _plain(sql: str, config: Config = Config()) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: engine(spark, sf_dir, config).run(sql)


def _planned(sql: str, planner: str, spec=None) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: engine(spark, sf_dir).run(sql, planner if spec is None else None, spec)


def _combined(conjunctive: bool) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark, sf_dir):
        e = engine(spark, sf_dir)
        return e.run(e.combine([f"{TOTALS} {JOINS} and {c}" for c in CLAUSES], conjunctive), "basic" if conjunctive else "tagged_combined")

    return run


def _group(name: str, how: str) -> Callable[[SparkSession, str], DataFrame]:
    """A group as one query that finds what any of its queries finds, or (shared) its queries over one join, numbered."""
    head, joins, conditions = GROUPS[name]

    def run(spark, sf_dir):
        e, group = engine(spark, sf_dir), [f"{head} where {joins} and {c}" for c in conditions]
        if how != "shared":
            return e.run(e.combine(group, how == "conj"))
        e.release()
        return reduce(DataFrame.unionByName, [f.withColumn("query", F.lit(i)) for i, f in enumerate(e.run_shared(group))])

    return run


def selectivity(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = engine(spark, sf_dir)
    q, plan, _ = e.plan("select l_orderkey from lineitem where l_quantity < 5", "basic")
    return spark.createDataFrame([(plan.context.root.selectivity,)], "sel double")


def distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = engine(spark, sf_dir)
    q, plan, _ = e.plan("select o_orderkey from orders, customer where o_custkey = c_custkey", "basic")
    edge = plan.context.edges[0]
    return spark.createDataFrame([(int(e.statistics.unique(q, edge.of("orders"))),)], "n long")


def streamed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The DNF filter over a stream of events, run until the stream is drained."""
    from orweave.streaming import continuous

    e = Engine(spark, sf_dir)
    events = f"{sf_dir}/event[s].parquet"  # as a pattern: a stream reads folders or patterns, not a file
    e.catalog.register("events", spark.readStream.schema(spark.read.parquet(events).schema).parquet(events))
    frame = continuous(e, EVENTS)
    top = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")  # both are shared
    out = f"{top.rstrip('/')}/orweave-stream-{uuid.uuid4().hex}"
    query = frame.writeStream.format("parquet").option("checkpointLocation", f"{out}-checkpoint").trigger(availableNow=True).start(out)
    query.awaitTermination()
    return spark.read.schema(frame.schema).parquet(out)


EVENTS = "select event_id, c_name, value from events, customer where user_id = c_custkey and ((value < 10 and c_acctbal < 500) or (event_type = 'click' and c_mktsegment = 'BUILDING'))"
REGEX = Config(settings=Settings(like="regex"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = {name: _plain(ours) for name, (ours, _) in QUERIES.items()}
    found["like_compat_regex"] = _plain("select p_partkey from part where p_name like 'wid%t'", REGEX)
    found |= {f"{q}_query": _plain(sql) for q, sql in PLANNED.items()}
    for q, sql in PLANNED.items():
        for planner in PLANNERS:
            if planner == "tagged_spec":
                found[f"{q}__{planner}"] = _planned(sql, planner, SPECS[q])
            elif planner != "basic_disj" or q in ("dnf", "wide"):
                found[f"{q}__{planner}"] = _planned(sql, planner)
    found |= {"or_combine_disj": _combined(False), "or_combine_conj": _combined(True), "selectivity_stat": selectivity, "unique_stat": distinct, "stream_disjunction": streamed}
    return found | {f"group_{g}__{how}": _group(g, how) for g in GROUPS for how in ("disj", "conj", "shared")}


def oracle_sql() -> dict[str, str]:
    found = {name: theirs or ours for name, (ours, theirs) in QUERIES.items()}
    found["like_compat_regex"] = "select p_partkey from part where regexp_matches(p_name, 'wid.*t')"
    for name in queries():
        base = name.split("__")[0].removesuffix("_query")
        if base in PLANNED and name not in found:
            found[name] = PLANNED[base]
    found |= {"or_combine_disj": DNF, "or_combine_conj": DNF, "stream_disjunction": EVENTS}
    for g, (head, joins, conditions) in GROUPS.items():
        found[f"group_{g}__disj"] = found[f"group_{g}__conj"] = f"{head} where {joins} and ({' or '.join(f'({c})' for c in conditions)})"
        found[f"group_{g}__shared"] = " union all ".join(f"select *, {i} as query from ({head} where {joins} and {c})" for i, c in enumerate(conditions))
    found["selectivity_stat"] = "select avg(cast(case when l_quantity < 5 then 1 else 0 end as double)) as sel from lineitem"
    found["unique_stat"] = "select count(distinct o_custkey) as n from orders"
    return found
