"""User SQL over an allow-list of views, and a bulk audit of logged query texts.

``scoped_sql`` asks Spark's own parser for the unresolved plan and accepts only read operators, listed functions and
one-part table names from the allow-list; anything that names a function or table at run time is refused. The text is
executed after that check, over views that exist during its analysis only. ``query_audit`` judges a whole log with
expressions.
"""

from __future__ import annotations

import threading
from collections.abc import Iterator, Mapping
from contextlib import contextmanager

from pyspark.errors import ParseException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from citewise.functions.questions import NO_QUERY
from citewise.functions.text import strip

MAX_ROWS = 500

# Logical operators a read-only SELECT may contain.
READ_OPERATORS = frozenset({
    "Aggregate", "CTERelationDef", "CTERelationRef", "Deduplicate", "Distinct", "Except", "Expand", "Filter", "Generate",
    "GlobalLimit", "Intersect", "Join", "LateralJoin", "LocalLimit", "Offset", "OneRowRelation", "Pivot", "Project",
    "Sample", "Sort", "SubqueryAlias", "Union", "UnresolvedHaving", "UnresolvedInlineTable", "UnresolvedRelation",
    "UnresolvedSubqueryColumnAliases", "UnresolvedWith", "Unpivot", "Window", "WithCTE", "WithWindowDefinition",
})
WRAPPERS = frozenset({"GlobalLimit", "LocalLimit", "Offset", "Sort", "UnresolvedWith", "WithWindowDefinition"})
SELECT_ROOTS = frozenset({"Aggregate", "Project", "UnresolvedHaving"})
# Unresolved expressions that name nothing but columns of the query's own tables, or are checked by name.
PLAIN_EXPRESSIONS = frozenset({
    "UnresolvedAlias", "UnresolvedAttribute", "UnresolvedExtractValue", "UnresolvedFunction", "UnresolvedGenerator",
    "UnresolvedNamedLambdaVariable", "UnresolvedOrdinal", "UnresolvedStar",
})
# Functions a query may call; none reaches the host, a file, the session or the JVM.
FUNCTIONS = frozenset("""
any any_value approx_count_distinct array_agg avg bit_and bit_or bit_xor bool_and bool_or collect_list collect_set corr count count_if
covar_pop covar_samp every first grouping grouping_id kurtosis last listagg max max_by mean median min min_by mode percentile
percentile_approx percentile_cont percentile_disc skewness some std stddev stddev_pop stddev_samp string_agg sum try_avg try_sum
var_pop var_samp variance
cume_dist dense_rank first_value lag last_value lead nth_value ntile percent_rank rank row_number
abs acos asin atan atan2 bround cbrt ceil ceiling cos degrees div e exp floor greatest least ln log log10 log2 mod negative pi pmod
positive pow power radians rint round sign signum sin sqrt tan try_add try_divide try_multiply try_subtract width_bucket
ascii base64 bit_length btrim char char_length character_length chr concat concat_ws contains endswith format_number hex ilike initcap
instr lcase left len length levenshtein like locate lower lpad ltrim md5 octet_length position regexp_count regexp_extract
regexp_extract_all regexp_instr regexp_like regexp_replace regexp_substr replace reverse right rlike rpad rtrim sha2 split split_part
startswith substr substring substring_index to_char to_number translate trim ucase unhex upper
between case coalesce if ifnull in isnan isnotnull isnull not nullif nullifzero nvl nvl2 when zeroifnull
add_months current_date current_timestamp date_add date_diff date_format date_from_unix_date date_part date_sub date_trunc dateadd
datediff datepart day dayname dayofmonth dayofweek dayofyear extract from_unixtime hour last_day make_date minute month monthname
months_between next_day now quarter second to_date to_timestamp trunc unix_date unix_timestamp weekday weekofyear year
bigint binary boolean cast date decimal double float int smallint string timestamp tinyint try_to_date try_to_number try_to_timestamp
array array_contains array_distinct array_join array_max array_min array_position array_size array_sort cardinality element_at explode
explode_outer named_struct posexplode size slice sort_array struct
""".split())


class ScopedQueryError(ValueError):
    """The query text is not one plain SELECT over the allowed tables."""


@contextmanager
def _double_quoted_names(spark: SparkSession) -> Iterator[None]:
    key = "spark.sql.ansi.doubleQuotedIdentifiers"
    before = spark.conf.get(key)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def _name(node) -> str:
    return node.getClass().getSimpleName()


def _items(seq) -> list:
    return [seq.apply(i) for i in range(seq.size())]


def _inside(plan, named: frozenset[str] = frozenset()) -> Iterator[tuple]:
    """Every operator of a plan with the subquery names in scope there, subqueries and named bodies included."""
    yield plan, named
    if _name(plan) == "UnresolvedWith":
        if plan.allowRecursion():
            raise ScopedQueryError("Statement contains a forbidden operation: recursion")
        for relation in _items(plan.cteRelations()):
            yield from _inside(relation._2(), named)
            named = named | {relation._1().lower()}
    for child in [*_items(plan.children()), *_items(plan.subqueries())]:
        yield from _inside(child, named)


def _expressions(plan) -> Iterator:
    waiting = _items(plan.expressions())
    while waiting:
        expression = waiting.pop()
        yield expression
        waiting += _items(expression.children())


def _check_expression(expression) -> None:
    kind, place = _name(expression), expression.getClass().getName()
    if ".catalyst.expressions." not in place and kind not in PLAIN_EXPRESSIONS:
        raise ScopedQueryError(f"Statement contains a forbidden operation: {kind}")
    if kind in ("UnresolvedFunction", "UnresolvedGenerator"):
        parts = _items(expression.nameParts()) if kind == "UnresolvedFunction" else [expression.name().unquotedString()]
        if len(parts) != 1 or parts[0].lower() not in FUNCTIONS:
            raise ScopedQueryError(f"Statement contains a forbidden operation: {'.'.join(parts)}")


def _select_root(plan):
    while _name(plan) in WRAPPERS:
        plan = plan.children().apply(0)
    return plan.children().apply(0) if _name(plan) == "Distinct" else plan


def checked_tables(spark: SparkSession, sql: str, allowed: set[str]) -> list[str]:
    """Tables a query reads; raises ScopedQueryError unless it is one SELECT over ``allowed``."""
    text = sql.strip().rstrip(";").strip()
    if not text or text.upper() == NO_QUERY:
        raise ScopedQueryError(NO_QUERY)
    with _double_quoted_names(spark):
        try:
            plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(text)
        except ParseException as exc:
            raise ScopedQueryError(f"Could not parse the query: {exc}") from exc
    if _name(_select_root(plan)) not in SELECT_ROOTS:
        raise ScopedQueryError("Only read-only SELECT statements are allowed.")
    tables, known = set(), set(allowed)
    for node, named in _inside(plan):
        kind = _name(node)
        if kind not in READ_OPERATORS:
            raise ScopedQueryError(f"Statement contains a forbidden operation: {kind}")
        if kind == "UnresolvedRelation":
            parts = _items(node.multipartIdentifier())
            if len(parts) > 1 or parts[0].lower() not in named:
                tables.add(".".join(parts))
        for expression in _expressions(node):
            _check_expression(expression)
    if outside := tables - known:
        raise ScopedQueryError(f"Query references tables outside this session: {sorted(outside)}")
    return sorted(tables)


_VIEWS = threading.RLock()


@contextmanager
def _views(spark: SparkSession, views: Mapping[str, DataFrame]) -> Iterator[None]:
    """The views for the time of one analysis; views of the session that had their names come back afterwards."""
    with _VIEWS:
        hidden = {t.name.lower(): spark.table(f"`{t.name}`") for t in spark.catalog.listTables() if t.isTemporary and t.name.lower() in {v.lower() for v in views}}
        try:
            for name, df in views.items():
                df.createOrReplaceTempView(name)
            yield
        finally:
            for name in views:
                spark.catalog.dropTempView(name)
            for name, df in hidden.items():
                df.createOrReplaceTempView(name)


def scoped_sql(spark: SparkSession, sql: str, views: Mapping[str, DataFrame], max_rows: int = MAX_ROWS) -> DataFrame:
    """Run one checked SELECT over ``views`` (name -> DataFrame), at most ``max_rows`` rows.

    The session's own views and tables are neither seen nor changed by it.
    """
    checked_tables(spark, sql, set(views))
    with _views(spark, views), _double_quoted_names(spark):
        return spark.sql(sql.strip().rstrip(";").strip()).limit(max_rows)


# Patterns of the audit.
LITERAL = r"'(?:[^']|'')*'"
COMMENT = r"--[^\n]*|/\*(?s:.*?)\*/"
FORBIDDEN = (
    r"(?i)\b(insert|update|delete|drop|alter|create|truncate|grant|revoke|merge|attach|pragma|copy|call|execute)\b"
)
TABLE_NAME = r'[A-Za-z_"`][\w."`]*'
FROM_LIST = (
    rf"(?i)\b(?:from|join)\s+({TABLE_NAME}(?:(?:\s+(?:as\s+)?(?!where|on|join|left|right|inner|full|cross|group|order|"
    rf"limit|having|union|intersect|except|using|natural|offset)\w+)?\s*,\s*{TABLE_NAME})*)"
)
DEFINED_NAME = r'(?i)(?:\bwith\s+(?:recursive\s+)?|,\s*)([\w"]+)\s+as\s*\('


def _bare(names: Column) -> Column:
    return F.array_distinct(F.transform(names, lambda n: F.translate(n, '"`', "")))


def query_audit(log: DataFrame, max_rows: int = MAX_ROWS) -> DataFrame:
    """log(query_id, sql, allowed array<string>, ...) + verdict, outside (tables), row_limit."""
    text = strip(F.rtrim(strip(F.coalesce("sql", F.lit(""))), F.lit(";")))
    bare = F.regexp_replace(F.regexp_replace(text, LITERAL, "''"), COMMENT, " ")
    named = F.flatten(F.transform(F.regexp_extract_all("_bare", F.lit(FROM_LIST), F.lit(1)), lambda l: F.split(l, r"\s*,\s*")))
    tables = F.transform(named, lambda t: F.split(t, r"\s+")[0])
    defined = F.regexp_extract_all("_bare", F.lit(DEFINED_NAME), F.lit(1))
    outside = F.array_except(F.array_except(_bare(tables), _bare(defined)), F.col("allowed"))
    shallow = F.aggregate(
        F.sequence(F.lit(1), F.lit(12)), F.col("_bare"), lambda acc, _: F.regexp_replace(acc, r"\([^()]*\)", " ")
    )
    plain_words = F.regexp_replace("_bare", r'"[^"]*"|`[^`]*`', " ")
    asked = F.regexp_extract("_bare", r"(?i)\blimit\s+(\d+)\s*$", 1).try_cast("bigint")
    judged = log.withColumn("_text", text).withColumn("_bare", bare).withColumn("_outside", outside)
    verdict = (
        F.when((F.col("_text") == "") | (F.upper("_text") == NO_QUERY), "empty")
        .when(F.col("_bare").contains(";"), "stacked")
        .when(~F.col("_bare").rlike(r"(?i)^\s*\(*\s*(select|with)\b"), "not_select")
        .when(shallow.rlike(r"(?i)\b(union|intersect|except)\b"), "not_select")
        .when(plain_words.rlike(FORBIDDEN), "forbidden")
        .when(F.size("_outside") > 0, "out_of_scope")
        .when(asked > max_rows, "capped")
        .otherwise("ok")
    )
    accepted = F.col("verdict").isin("ok", "capped")
    limit = F.least(F.coalesce(asked, F.lit(max_rows)), F.lit(max_rows)).cast("bigint")
    return (
        judged.withColumn("verdict", verdict)
        .withColumn("row_limit", F.when(accepted, limit))
        .withColumn("outside", F.array_join(F.array_sort("_outside"), ","))
        .drop("_text", "_bare", "_outside")
    )
