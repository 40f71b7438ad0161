"""A guard for ad-hoc SQL: one read-only statement, allowed tables, functions and plan nodes, a bounded size.

Words are checked once literals and comments are gone. Then the parsed plan is walked for functions,
of which only named ones are allowed, and the analysed plan for tables and for what reads the
session, so a name that words don't show (a view, a quoted path, a subquery) is still found. Last,
the optimiser's estimate of what any step makes must stay below a limit. Nothing runs before that."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from ledgerloom.lineage import cut

LITERAL = re.compile(r"'(?:[^'\\]|\\.|'')*'|\"(?:[^\"\\]|\\.)*\"|--[^\n]*|/\*.*?\*/", re.S)
#: Statements that change something or reach outside (fixed values).
FORBIDDEN = (
    "insert", "update", "delete", "merge", "drop", "create", "alter", "truncate", "set", "reset", "use", "cache", "uncache", "refresh", "load", "export",
    "add", "grant", "revoke", "call", "analyze", "msck", "replace", "java_method", "reflect", "try_reflect", "read_files", "transform",
)
DENIED_NODES = re.compile(r"\b(Command|InsertInto\w*|CreateTable\w*|DropTable\w*|ScriptTransformation|LogicalRDD|SetCatalog\w*|CreateView\w*|WriteToDataSource\w*)\b")


#: Leaves that read no table; references to common table expressions are checked where those are defined.
FREE_LEAVES = re.compile(r"(OneRowRelation|LocalRelation|Range|CTERelationRef)\b")


#: Functions that may be called.
FUNCTIONS = frozenset(
    """
    count sum avg mean min max min_by max_by first last any_value collect_list collect_set count_if bool_and bool_or every some stddev variance median mode percentile percentile_approx approx_count_distinct array_agg listagg string_agg grouping
    row_number rank dense_rank ntile lag lead first_value last_value nth_value percent_rank cume_dist
    abs ceil ceiling floor round bround sqrt exp ln log log2 log10 power pow mod pmod sign greatest least try_divide try_add try_subtract try_multiply div
    coalesce nullif ifnull nvl nvl2 if isnull isnotnull isnan nanvl cast try_cast
    lower upper lcase ucase trim ltrim rtrim btrim length char_length character_length substr substring substring_index left right concat concat_ws replace regexp_replace regexp_extract regexp_extract_all regexp_count regexp_like rlike like ilike contains startswith endswith instr locate position split split_part lpad rpad initcap reverse levenshtein soundex translate ascii chr format_number
    date to_date to_timestamp date_add date_sub datediff date_diff date_trunc trunc date_format year quarter month day dayofmonth dayofweek dayofyear hour minute second weekofyear add_months months_between last_day make_date extract date_part current_date now current_timestamp
    array struct named_struct map size cardinality array_contains array_distinct array_join array_sort sort_array array_max array_min array_union array_intersect array_except array_position array_remove flatten slice element_at try_element_at get transform filter exists forall aggregate reduce zip_with map_keys map_values map_entries explode explode_outer posexplode posexplode_outer inline
    get_json_object from_json to_json md5 sha2 crc32 hash xxhash64 string int bigint double float boolean decimal timestamp not and or in between case when
    """.split()
)
#: Expressions that read the session or the files, or call other code, however they are written.
DENIED_EXPRESSIONS = re.compile(r"(CurrentUser|SessionUser|InputFile\w*|CurrentCatalog|CurrentDatabase|SparkVersion|SparkPartitionID|CallMethodViaReflection|TryReflect|PythonUDF|ScalaUDF|ScalaAggregator|Uuid|Rand\w*|MonotonicallyIncreasingID|UserDefined\w*)$")
#: Bytes that any step may make by the optimiser's estimate.
LARGEST = 1 << 40


class Refused(ValueError):
    """The query isn't allowed; the message says why."""


def bare(query: str) -> str:
    return LITERAL.sub(" ", query)


def lexical_check(query: str) -> None:
    words = bare(query).strip().rstrip(";").strip()
    if not words:
        raise Refused("the query is empty")
    if ";" in words:
        raise Refused("only one statement is allowed")
    if not re.match(r"(?i)(select|with|from|values)\b", words):
        raise Refused("only SELECT statements are allowed")
    found = re.search(rf"(?i)\b({'|'.join(FORBIDDEN)})\b", words)
    if found:
        raise Refused(f"{found[1].lower()} isn't allowed")
    if "`" in words and re.search(r"(?i)\b(parquet|csv|json|text|orc|binaryfile|avro|xml)\s*\.\s*`", words):
        raise Refused("files can't be read by path")


def lines_of(plan: str) -> list[tuple[int, str]]:
    """(depth, text) of the nodes of a printed plan."""
    found = (re.match(r"[\s:+|-]*", line) for line in plan.split("\n") if line.strip())
    return [(m.end(), m.string[m.end() :]) for m in found]


def plan_check(df: DataFrame, tables: set[str]) -> None:
    """The analysed plan reads allowed tables alone, and does nothing else.

    Every leaf must lie below the view of an allowed table; what is within such a view is its own
    affair. Leaves that read nothing (one row, inline values) are free."""
    text = df._jdf.queryExecution().analyzed().treeString()
    known, view, bad = {t.lower() for t in tables}, None, set()
    nodes = lines_of(text)
    for k, (depth, node) in enumerate(nodes):
        if view is not None and depth > view:
            continue
        view = None
        if found := DENIED_NODES.search(re.sub(r"\[.*?\]", "", node)):
            raise Refused(f"{found[1]} isn't allowed")
        if m := re.match(r"View \(`?([^`,)]+)", node):
            name = m[1].lower().split(".")[-1]
            bad |= {name} - known
            view = depth
        elif (k + 1 == len(nodes) or nodes[k + 1][0] <= depth) and not FREE_LEAVES.match(node):
            bad.add(re.match(r"\w+", node)[0].lower() if re.match(r"\w+", node) else node)
    if bad:
        raise Refused(f"not allowed: {', '.join(sorted(bad))}")


def listed(found) -> list:
    return [found.apply(k) for k in range(found.size())]


def kind_of(node) -> str:
    return node.getClass().getSimpleName().rstrip("$")


def expressions_of(plan):
    """Every expression of a plan, with those of subqueries; not what lies below views."""
    plans = [plan]
    while plans:
        node = plans.pop()
        if kind_of(node) == "View":
            continue
        plans += listed(node.children()) + listed(node.innerChildren())
        held = listed(node.expressions())
        while held:
            expression = held.pop()
            yield expression
            held += listed(expression.children())
            if kind_of(expression) in ("ScalarSubquery", "LateralSubquery", "Exists", "ListQuery"):
                plans.append(expression.plan())


def function_check(spark: SparkSession, query: str, allowed: frozenset[str] = FUNCTIONS) -> None:
    """Every function that the parsed query calls is allowed, in its tables as well."""
    parsed = spark._jsparkSession.sessionState().sqlParser().parsePlan(query)
    if found := re.search(r"UnresolvedTableValuedFunction \[(\w+)", parsed.treeString()):
        raise Refused(f"table function {found[1]} isn't allowed")
    called = set()
    for e in expressions_of(parsed):
        if kind_of(e) == "UnresolvedFunction":
            called.add(e.nameParts().mkString(".").lower())
        elif kind_of(e) == "UnresolvedGenerator":  # of a LATERAL VIEW
            called.add(e.name().funcName().lower())
    if bad := called - allowed:
        raise Refused(f"functions not allowed: {', '.join(sorted(bad))}")


def size_check(df: DataFrame, largest: int = LARGEST) -> None:
    """No step of the optimised plan makes more than largest bytes by the optimiser's estimate."""
    plans = [df._jdf.queryExecution().optimizedPlan()]
    while plans:
        node = plans.pop()
        if (size := int(str(node.stats().sizeInBytes()))) > largest:
            raise Refused(f"too large: {kind_of(node)} may make {size} bytes, {largest} are allowed")
        plans += listed(node.children())


def run_guarded(spark: SparkSession, query: str, tables: dict[str, DataFrame], cap: int = 50_000, functions: frozenset[str] = FUNCTIONS, largest: int = LARGEST) -> tuple[DataFrame, bool]:
    """Rows of a checked query, at most cap, and whether there are more."""
    lexical_check(query)
    function_check(spark, query.strip().rstrip(";"), functions)
    for name, df in tables.items():
        df.createOrReplaceTempView(name)
    df = spark.sql(query.strip().rstrip(";"))
    plan_check(df, set(tables))
    if bad := {kind_of(e) for e in expressions_of(df._jdf.queryExecution().analyzed()) if DENIED_EXPRESSIONS.match(kind_of(e))}:
        raise Refused(f"not allowed: {', '.join(sorted(bad))}")
    size_check(df, largest)
    rows = cut(df.limit(cap + 1), "guarded")  # evaluated once, for the rows and for their number
    return rows.limit(cap), rows.count() > cap
