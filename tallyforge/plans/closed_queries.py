"""A closed catalog of reviewed, parameterized queries that see one owner's rows only."""

from __future__ import annotations

import re
from dataclasses import dataclass
from datetime import date
from math import ceil

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.functions.lineage import cut
from tallyforge.plans import inspection

# fixed values: classifications from least to most protected
CLASSES = ("public", "internal", "personal", "financial", "secret")
FORBIDDEN = re.compile(r"\b(or|union|intersect|except|join|with|insert|update|delete|merge|drop|create|alter|call)\b", re.I)
IDENTIFIER = re.compile(r"[A-Za-z0-9_-]{1,64}")


@dataclass(frozen=True)
class Parameter:
    name: str
    kind: str  # string, int, float, bool, date or identifier
    least: float | None = None
    most: float | None = None
    allowed: tuple | None = None
    session: bool = False  # never given by the caller


@dataclass(frozen=True)
class Column:
    name: str
    kind: str
    classification: str = "internal"


@dataclass(frozen=True)
class Entry:
    query_id: str
    version: str
    table: str
    sql: str
    parameters: tuple[Parameter, ...]
    columns: tuple[Column, ...]
    roles: tuple[str, ...] = ("client", "operator")
    max_rows: int = 50
    max_bytes: int = 200 * 1024 * 1024


class Rejected(ValueError):
    """rule names what a dry run found, where it is one of the closed rules."""

    def __init__(self, message: str, rule: str | None = None):
        super().__init__(message)
        self.rule = rule


def check_sql(entry: Entry) -> None:
    """One SELECT of named columns from the entry's table, whose first condition is ownership."""
    sql = entry.sql
    if not re.match(r"\s*select\b", sql, re.I) or len(re.findall(r"\bselect\b", sql, re.I)) != 1:
        raise Rejected("a query is a single SELECT")
    for found, message in (
        (re.search(r";|--|/\*", sql), "no statement separators or comments"),
        (re.search(r"select\s+\*|\.\*", sql, re.I), "columns are named, * is not allowed"),
        (FORBIDDEN.search(sql), "no OR, JOIN, WITH, set operation or statement that writes"),
    ):
        if found:
            raise Rejected(message)
    if re.findall(r"\bfrom\s+(\S+)", sql, re.I) != ["{" + entry.table + "}"]:
        raise Rejected("the query reads its own table only")
    if not re.search(r"\bwhere\s+customer_id\s*=\s*:customer_id\b", sql, re.I):
        raise Rejected("the first condition is customer_id = :customer_id")
    limit = re.search(r"\blimit\s+(\d+)\s*$", sql, re.I)
    if not limit or int(limit[1]) > entry.max_rows:
        raise Rejected("the query ends in a LIMIT of at most max_rows")
    if set(re.findall(r":(\w+)", sql)) != {p.name for p in entry.parameters}:
        raise Rejected("placeholders and declared parameters differ")


def load(entries: list[Entry]) -> dict[str, Entry]:
    """All entries or none; a query id and version may occur once."""
    out: dict[str, Entry] = {}
    for entry in entries:
        check_sql(entry)
        key = f"{entry.query_id}@{entry.version}"
        if key in out:
            raise Rejected(f"{key} occurs twice")
        out[key] = entry
    return out


def listing(catalog: dict[str, Entry], role: str) -> list[str]:
    return sorted(key for key, entry in catalog.items() if role in entry.roles)


def _checked(parameter: Parameter, value):
    kinds = {"string": str, "identifier": str, "date": str, "int": int, "float": (int, float), "bool": bool}
    if not isinstance(value, kinds[parameter.kind]) or (isinstance(value, bool) and parameter.kind != "bool"):
        raise Rejected(f"{parameter.name} is not of type {parameter.kind}")
    if parameter.kind == "identifier" and not IDENTIFIER.fullmatch(value):
        raise Rejected(f"{parameter.name} is no identifier")
    if parameter.kind == "date":
        try:
            value = date.fromisoformat(value)
        except ValueError:
            raise Rejected(f"{parameter.name} is no calendar date") from None
    if parameter.allowed is not None and value not in parameter.allowed:
        raise Rejected(f"{parameter.name} has a value that is not allowed")
    if (parameter.least is not None and value < parameter.least) or (parameter.most is not None and value > parameter.most):
        raise Rejected(f"{parameter.name} is out of range")
    return value


def bind(entry: Entry, given: dict, session: dict) -> dict:
    """Values of all parameters; the session's own cannot come from the caller."""
    named = {p.name: p for p in entry.parameters}
    if extra := sorted(set(given) - {n for n, p in named.items() if not p.session}):
        raise Rejected(f"unexpected values: {', '.join(extra)}")
    values = {}
    for name, parameter in named.items():
        source = session if parameter.session else given
        if name not in source:
            raise Rejected(f"{name} is missing")
        values[name] = _checked(parameter, source[name])
    return values


def execute(spark: SparkSession, entry: Entry, table: DataFrame, given: dict, session: dict, role: str) -> DataFrame:
    """The rows, with declared columns of declared types, at most max_rows of them."""
    if role not in entry.roles:
        raise Rejected("the role may not run this query")
    check_sql(entry)
    values = bind(entry, given, session)
    out = spark.sql(entry.sql, args=values, **{entry.table: table})
    dry_run(entry, out, values)
    return out


#: Folders of owners are made so small that this many would still be within an entry's bytes.
WITHIN = 8


def of_owner(entry: Entry, table: DataFrame, session: dict) -> DataFrame:
    """The table as the entry may read it: as it is if it is small enough, else the folder of the session's owner.

    A large table is written once, with the columns that the entry names, in folders by the owner's hash. Their number grows with
    the table, so what a query reads does not; an owner with too many rows for the cap is still refused.
    """
    size = inspection.scan_bytes(table)
    if size is None or size <= entry.max_bytes:
        return table
    folder = lambda owner: F.pmod(F.xxhash64(owner), F.lit(ceil(size * WITHIN / entry.max_bytes))).cast("int")
    named = set(re.findall(r"\w+", entry.sql))
    rows = table.select(*[c for c in table.columns if c in named], folder(F.col(OWNER.name)).alias("owner_folder"))
    laid = cut(rows.repartition("owner_folder"), "owners", by="owner_folder")
    return laid.where(F.col("owner_folder") == folder(F.lit(str(session[OWNER.name])))).drop("owner_folder")


def dry_run(entry: Entry, out: DataFrame, values: dict) -> None:
    """Check a query against its plan before it runs: shape, ownership, declared columns and types, bytes after pruning."""
    try:
        inspection.check_shape(out, OWNER.name, str(values[OWNER.name]), entry.max_rows)
    except inspection.Refused as refused:
        raise Rejected(str(refused), "plan_not_allowed") from None
    declared = {c.name: c.kind for c in entry.columns}
    if out.columns != list(declared):
        raise Rejected(f"the result has {out.columns}, declared are {list(declared)}", "schema_column_mismatch")
    if out.dtypes != list(declared.items()):
        raise Rejected(f"the result has {out.dtypes}, declared are {list(declared.items())}", "schema_type_mismatch")
    size = inspection.scan_bytes(out)
    if size is None:
        raise Rejected("a source does not say how much the query would read", "bytes_unknown")
    if size > entry.max_bytes:
        raise Rejected(f"the query would read {size} bytes, {entry.max_bytes} are allowed", "bytes_over_budget")


@dataclass(frozen=True)
class Plan:
    """An entry of the older catalog: named parameters only, the tenant always among them, few rows."""

    plan_id: str
    table: str
    sql: str
    parameters: tuple[str, ...]
    max_rows: int = 8


def check_plan(plan: Plan) -> None:
    names = set(re.findall(r":(\w+)", plan.sql))
    if "tenant_id" not in names or not re.search(r"\bwhere\s+tenant_id\s*=\s*:tenant_id\b", plan.sql, re.I):
        raise Rejected("the first condition is tenant_id = :tenant_id")
    if names != {*plan.parameters, "tenant_id"} or "tenant_id" in plan.parameters:
        raise Rejected("placeholders and declared parameters differ")
    if not 1 <= plan.max_rows <= 8:
        raise Rejected("a plan gives eight rows at most")
    if FORBIDDEN.search(plan.sql) or re.search(r";|--|/\*|select\s+\*", plan.sql, re.I) or len(re.findall(r"\bselect\b", plan.sql, re.I)) != 1:
        raise Rejected("a plan is a single SELECT of named columns")
    if re.findall(r"\bfrom\s+(\S+)", plan.sql, re.I) != ["{" + plan.table + "}"]:
        raise Rejected("the plan reads its own table only")


def execute_plan(spark: SparkSession, plan: Plan, table: DataFrame, given: dict[str, str], tenant_id: str) -> DataFrame:
    """At most max_rows rows of the tenant; the values given are exactly those declared."""
    check_plan(plan)
    if set(given) != set(plan.parameters):
        raise Rejected("values and declared parameters differ")
    return spark.sql(plan.sql, args={**given, "tenant_id": tenant_id}, **{plan.table: table}).limit(plan.max_rows)


def evidence(entry: Entry, rows: DataFrame) -> dict:
    """Rows as plain values with the highest classification of their columns; fails on more than max_rows."""
    found = rows.limit(entry.max_rows + 1).collect()
    if len(found) > entry.max_rows:
        raise Rejected("the result has too many rows")
    highest = max((c.classification for c in entry.columns), key=CLASSES.index)
    return {"source": f"{entry.query_id}@{entry.version}", "columns": [c.name for c in entry.columns], "rows": [list(r) for r in found], "classification": highest}


OWNER = Parameter("customer_id", "identifier", session=True)
# fixed values: the queries that the service offers
ENTRIES = [
    Entry(
        "customer_products", "1", "products",
        "SELECT product_id, product_type, currency, current_balance, product_status, opening_date FROM {products} "
        "WHERE customer_id = :customer_id ORDER BY opening_date DESC, product_id LIMIT 50",
        (OWNER,),
        (Column("product_id", "string"), Column("product_type", "string"), Column("currency", "string"), Column("current_balance", "double", "financial"), Column("product_status", "string"), Column("opening_date", "date")),
    ),
    Entry(
        "product_status", "1", "products",
        "SELECT product_id, product_status FROM {products} WHERE customer_id = :customer_id AND product_id = :product_id LIMIT 1",
        (OWNER, Parameter("product_id", "identifier")),
        (Column("product_id", "string"), Column("product_status", "string")),
        max_rows=1,
    ),
    Entry(
        "recent_transactions", "1", "transactions",
        "SELECT transaction_id, transaction_date, amount, currency, transaction_status FROM {transactions} WHERE customer_id = :customer_id "
        "AND to_date(transaction_date) >= :date_from AND to_date(transaction_date) <= :date_to ORDER BY transaction_date DESC, transaction_id, amount LIMIT 20",
        (OWNER, Parameter("date_from", "date"), Parameter("date_to", "date")),
        (Column("transaction_id", "string"), Column("transaction_date", "timestamp_ntz"), Column("amount", "double", "financial"), Column("currency", "string"), Column("transaction_status", "string")),
        max_rows=20,
    ),
]


def demo_cohort(transactions: DataFrame, complaints: DataFrame, size: int = 3) -> DataFrame:
    """Customers with three pairs of transaction and complaint at least, one complaint about transactions among them.

    The pairs are never made: a customer's pairs are its transactions times its complaints (or one).
    """
    t = transactions.where("customer_id IS NOT NULL").groupBy("customer_id").agg(F.count("*").alias("t"))
    c = complaints.groupBy("customer_id").agg(F.count("*").alias("c"), F.count_if(F.col("category") == "Transactions").alias("own"))
    both = t.join(c, "customer_id", "left").where((F.col("t") * F.greatest(F.coalesce("c", F.lit(0)), F.lit(1)) >= 3) & (F.col("t") * F.col("own") >= 1))
    return both.orderBy(F.md5(F.col("customer_id").cast("binary")), "customer_id").limit(size).select("customer_id")
