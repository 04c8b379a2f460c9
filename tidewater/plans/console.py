"""A SQL console with guards: destructive statements are told and backed up, common slips are repaired."""

from __future__ import annotations

import re
import time
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import constants as K
from ..operators import classify, profile
from ..operators.shared import numbers, rows_frame, strings
from . import questions
from .advisor import Advisor

_destructive = re.compile(K.DESTRUCTIVE_ANYWHERE)
_destructive_start = re.compile(K.DESTRUCTIVE_START)
_name = r"(?:`(?:[^`]|``)+`|\"[^\"]+\"|\w+)"
_tables = re.compile(rf"\b(?:FROM|UPDATE|INTO|OVERWRITE(?:\s+TABLE)?|TABLE(?:\s+IF\s+EXISTS)?)\s+({_name}(?:\.{_name})*)", re.I)
#: Commands that change nothing, by the beginning of their plan's name.
READ_ONLY = ("Describe", "Show", "Explain", "Use", "SetCommand", "SetCatalogAndNamespace", "Analyze", "Refresh", "Cache", "Uncache", "ListFiles", "ListJars")
#: Words of questions for the standard looks at a table.
_STANDARD = frozenset("duplicate duplicates null nulls missing empty summary describe top first show preview find check any are there in the of me a table rows row values list all columns which what has have is give for please records record".split())
_group = re.compile(r"\bGROUP\s+BY\s+(?P<cols>.+?)(?=\s+HAVING\b|\s+ORDER\b|\s+LIMIT\b|;|$)", re.I | re.S)
_select = re.compile(r"\bSELECT\s+(?P<cols>.+?)\s+FROM\b", re.I | re.S)


def is_destructive(sql: str) -> bool:
    """Does any statement of the text change data or tables?"""
    return bool(_destructive.search(sql)) or any(_destructive_start.match(s) for s in sql.split(";"))


def changes_data(spark: SparkSession, sql: str) -> bool:
    """Does Spark's parser find a command or an insert anywhere in the plan of a statement, below WITH and FROM too? What it
    can't parse is judged by its words."""
    try:
        todo = [spark._jsparkSession.sessionState().sqlParser().parsePlan(sql)]
    except Exception:
        return is_destructive(sql)
    kinds = [spark._jvm.java.lang.Class.forName(f"org.apache.spark.sql.catalyst.plans.logical.{k}") for k in ("Command", "ParsedStatement")]
    while todo:
        plan = todo.pop()
        if any(k.isInstance(plan) for k in kinds) and not plan.getClass().getSimpleName().startswith(READ_ONLY):
            return True
        children = plan.children()
        todo += [children.apply(i) for i in range(children.size())]
    return False


def table_names(sql: str) -> list[str]:
    """Tables after FROM, INTO and the like as they are written, qualified and back-ticked names whole, without plain quotes."""
    return sorted({x.replace('"', "") for x in _tables.findall(sql) if x.upper() not in ("TABLE", "IF")})


def tables_in(spark: SparkSession, sql: str) -> list[str]:
    """Tables that a statement reads or changes, as Spark's parser names them: in every subquery and WITH, without the names that
    WITH defines, without what stands in literals and comments. What it can't parse is searched by table_names."""
    try:
        todo = [spark._jsparkSession.sessionState().sqlParser().parsePlan(sql)]
    except Exception:
        return table_names(sql)
    items = lambda seq: [seq.apply(i) for i in range(seq.size())]
    found, defined = set(), set()
    while todo:
        plan = todo.pop()
        kind = plan.getClass().getSimpleName()
        if kind in ("UnresolvedRelation", "UnresolvedTable", "UnresolvedTableOrView", "UnresolvedView"):
            found.add(".".join(items(plan.multipartIdentifier())))
        elif kind == "UnresolvedIdentifier":
            found.add(".".join(items(plan.nameParts())))
        elif kind == "InsertIntoStatement":
            todo.append(plan.table())
        elif kind == "UnresolvedWith":
            for x in items(plan.cteRelations()):
                defined.add(x._1().lower())
                todo.append(x._2())
        todo += [*items(plan.children()), *items(plan.subqueries())]
    return sorted(x for x in found if x.lower() not in defined)


def question_intent(question: str) -> str:
    """write if the question asks for a change, else read."""
    return classify.question_intent(question)


def fix_group_by(sql: str) -> str:
    """Adds grouped columns that the first SELECT lacks; `SELECT *` becomes the grouped columns and a count."""
    group, select = _group.search(sql), _select.search(sql)
    if not group or not select:
        return sql
    wanted, chosen = group["cols"].strip(), select["cols"].strip()
    if chosen == "*":
        new = f"{wanted}, COUNT(*) as count"
    elif wanted.split(",")[0].strip().lower() in chosen.lower():
        return sql
    else:
        new = f"{wanted}, {chosen}"
    return sql[: select.start("cols")] + new + sql[select.end("cols") :]


def alias_derived_tables(sql: str) -> str:
    """Gives `FROM (SELECT ...)` without a name the name t1, t2, ..."""
    out, at, n = [], 0, 0
    for m in re.finditer(r"\bFROM\s+\(\s*SELECT\b", sql, re.I):
        depth, end = 0, sql.index("(", m.start())
        for end in range(end, len(sql)):
            depth += (sql[end] == "(") - (sql[end] == ")")
            if not depth:
                break
        if not re.match(r"\s+(AS\s+)?(?!LIMIT\b|ORDER\b|GROUP\b|HAVING\b|WHERE\b|UNION\b|JOIN\b|ON\b)\w", sql[end + 1 :], re.I) and end >= at:
            n += 1
            out.append(sql[at : end + 1] + f" AS t{n}")
            at = end + 1
    return "".join(out) + sql[at:]


def quote(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def suggestions(table: str, columns: list[str]) -> list[tuple[str, str, str]]:
    """(label, category, SQL) of three first looks at a table: duplicates, missing values, a summary."""
    keys = ", ".join(quote(c) for c in columns[:3]) or "1"
    nulls = "\nUNION ALL\n".join(f"SELECT '{c}' AS column_name, COUNT(*) AS null_count FROM {quote(table)} WHERE {quote(c)} IS NULL" for c in columns[:8])
    distinct = quote(columns[0]) if columns else "1"
    return [
        ("Find duplicate rows", "Duplicates", f"SELECT {keys}, COUNT(*) AS duplicate_count FROM {quote(table)} GROUP BY {keys} HAVING COUNT(*) > 1 ORDER BY duplicate_count DESC"),
        ("Count missing values", "Missing Values", nulls),
        ("Summary", "Overview", f"SELECT COUNT(*) AS total_rows, COUNT(DISTINCT {distinct}) AS unique_count FROM {quote(table)}"),
    ]


def quick_actions(table: str, columns: list[str], order: str) -> dict[str, str]:
    """SQL of the standard questions by name."""
    s = suggestions(table, columns)
    return {"duplicates": s[0][2], "nulls": s[1][2], "summary": s[2][2], "top10": f"SELECT * FROM {quote(table)} ORDER BY {quote(order)} LIMIT 10", "count": f"SELECT COUNT(*) AS row_count FROM {quote(table)}"}


def wants_all_checks(question: str) -> bool:
    return any(p in question.lower() for p in K.CHECK_ALL_PHRASES)


def check_all(df: DataFrame) -> DataFrame:
    """check, column, n: rows, duplicate rows, null or blank values, values beyond three deviations and constant columns; all
    columns are checked, and only findings (and the two totals) are listed."""
    rows = [("rows", "", df.count()), ("duplicates", "", profile.exact_duplicate_count(df).first()[0])]
    rows += [("nulls", r["column"], r["null_count"]) for r in profile.null_or_blank(df).collect() if r["null_count"]]
    rows += [("outliers", r["column"], r["outliers"]) for r in profile.three_sigma(df).collect() if r["outliers"]] if numbers(df) else []
    rows += [("constant", r["column"], 1) for r in profile.constant_columns(df.select(*[F.col(quote(c)) for c in strings(df)])).collect() if r["is_constant"]] if strings(df) else []
    return rows_frame(df.sparkSession, rows, "check string, column string, n long")


#: Questions a console remembers, and those of them an advisor is told.
TURNS_KEPT, TURNS_TOLD = 20, 4


@dataclass
class Console:
    """Runs SQL over registered views. A destructive statement needs confirm=True, and its tables are copied first."""

    spark: SparkSession
    advisor: Advisor | None = None
    log: list[tuple] = field(default_factory=list)
    asked: list[str] = field(default_factory=list)

    def ask(self, question: str, tables: dict[str, list[str]]) -> str:
        """SQL for a question: by the advisor if there is one, else one of the standard questions on the table it names."""
        if self.advisor:
            return alias_derived_tables(fix_group_by(self.advisor.sql(question, tables)))
        if understood := questions.understand(question, tables):
            return understood.sql()
        low = question.lower()
        table = next((t for t in tables if t.lower() in low), next(iter(tables)))
        actions = quick_actions(table, tables[table], tables[table][0])
        if set(re.findall(r"\w+", low)) - set(re.findall(r"\w+", table.lower())) <= _STANDARD:
            for words, kind in ((("duplicate",), "duplicates"), (("null", "missing", "empty"), "nulls"), (("summary", "describe"), "summary"), (("top", "first", "show", "preview"), "top10")):
                if any(w in low for w in words):
                    return actions[kind]
        raise ValueError(f"not understood: {question}")

    def answer(self, question: str, tables: dict[str, list[str]]) -> dict:
        """What `ask` gives, with what to know before it runs: sql, explanation, is_destructive, pending_confirmation,
        affected_tables, intent_type, safety_warning, confidence."""
        self.asked = [*self.asked, question][-TURNS_KEPT:]
        sql, by_advisor = self.ask(question, tables), self.advisor is not None
        destructive = changes_data(self.spark, sql)
        used = tables_in(self.spark, sql)
        return {
            "sql": sql, "explanation": "written by the advisor" if by_advisor else "a standard question", "is_destructive": destructive, "pending_confirmation": destructive, "affected_tables": used,
            "intent_type": "write" if destructive else question_intent(question), "safety_warning": f"changes {', '.join(used) or 'data'}; copies are made first" if destructive else "", "confidence": 0.7 if by_advisor else 0.9,
        }

    def recent(self) -> list[str]:
        """The last questions, as an advisor is told them."""
        return self.asked[-TURNS_TOLD:]

    def run(self, sql: str, confirm: bool = False) -> DataFrame:
        """Result of a statement, repaired if it fails the first time. Every call is logged."""
        destructive = changes_data(self.spark, sql)
        if destructive and not confirm:
            raise PermissionError(f"this statement changes data and needs confirmation: {sql}")
        if destructive:
            for t in tables_in(self.spark, sql):
                if self.spark.catalog.tableExists(t):
                    self.backup(t)
        try:
            out = self.spark.sql(sql)
        except Exception:
            repaired = alias_derived_tables(fix_group_by(sql))
            if repaired == sql:
                self.log.append((time.time(), sql, destructive, "failed"))
                raise
            sql, out = repaired, self.spark.sql(repaired)
        self.log.append((time.time(), sql, destructive, "ok"))
        return out

    def backup(self, table: str) -> str:
        """A copy of a table under a new name, whole."""
        name = re.sub(r"\W+", "_", table).strip("_") + f"_backup_{int(time.time() * 1000)}"
        self.spark.table(table).write.saveAsTable(name)
        return name

    def history(self) -> DataFrame:
        return self.spark.createDataFrame(self.log, "at double, sql string, destructive boolean, status string")

    def relations(self, tables: list[str]) -> DataFrame:
        """Relations that column names suggest."""
        found = classify.relations({t: self.spark.table(t).columns for t in tables})
        return rows_frame(self.spark, found, "from_table string, from_col string, to_table string, to_col string, type string")
