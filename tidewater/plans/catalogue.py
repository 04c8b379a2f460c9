"""All queries over the test tables, and DuckDB SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import ImputationRule
from ..functions import constants as K
from ..functions import fuzzy
from ..functions import numbers as N
from ..functions import text as X
from ..operators import audit, classify, currency, dates, dedup, filters, graph, impute, mapping, outliers, profile, replay, rules, sketches, validate
from ..operators.shared import numbered, q, scratch_path
from . import console, core_sql, pipeline
from .planner import plan
from .testbed import TABLES, frame, with_tables

Query = Callable[[SparkSession, str], DataFrame]
_queries: dict[str, Query] = {}
_sql: dict[str, str] = {}


def _add(name: str, run: Query, sql: str | None = None, *tables: str) -> None:
    _queries[name] = run
    if sql is not None:
        used = [t for t in TABLES if t in tables]
        if used and sql.lstrip().upper().startswith("WITH RECURSIVE "):
            _sql[name] = with_tables(*used).replace("WITH ", "WITH RECURSIVE ", 1) + ", " + sql.lstrip()[15:]
            return
        _sql[name] = (with_tables(*used) + (", " if sql.lstrip().upper().startswith("WITH ") else " ") + (sql.lstrip()[5:] if sql.lstrip().upper().startswith("WITH ") else sql)) if used else sql


def _on(table: str, run: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda s, d: run(frame(s, d, table))


def _in(values) -> str:
    return "(" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + ")"


def queries() -> dict[str, Query]:
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    return dict(_sql)


_NUMBER = r"'^\s*[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?\s*$'"
_TITLE = "array_to_string(list_transform(regexp_extract_all({0}, '[\\p{{L}}]+|[^\\p{{L}}]+'), lambda x: upper(x[1]) || lower(x[2:])), '')"
_KEY = f"(CASE WHEN {{0}} IS NULL OR lower(trim({{0}})) IN {_in(K.DEDUP_MARKERS)} THEN '' ELSE lower(trim({{0}})) END)"
_PROFILE = f"(CASE WHEN lower(trim(CAST({{0}} AS VARCHAR))) NOT IN {_in(K.PROFILE_MARKERS)} THEN lower(trim(CAST({{0}} AS VARCHAR))) END)"
_LOADED = f"(CASE WHEN NOT ({{0}} IN {_in(K.LOAD_MARKERS)} OR regexp_matches({{0}}, '^\\s*$')) THEN {{0}} END)"
_DIGITS = r"regexp_replace({0}, '\D', '', 'g')"
_NATIONAL = f"(CASE WHEN length({_DIGITS}) = 12 AND starts_with({_DIGITS}, '91') THEN substr({_DIGITS}, 3) WHEN length({_DIGITS}) = 11 AND starts_with({_DIGITS}, '1') THEN substr({_DIGITS}, 2) ELSE {_DIGITS} END)"

# ---- profiles -------------------------------------------------------------------------------------------------------

_people = ["record_id", "full_name", "email", "phone", "city", "pan", "age", "salary", "segment", "active", "mostly_empty"]
_text = ["full_name", "email", "phone", "city", "pan", "segment", "active", "mostly_empty"]
_loaded = lambda c: _LOADED.format(c) if c in _text else c


def _union(columns: list[str], body: Callable[[str], str], source: str) -> str:
    return " UNION ALL ".join(f"SELECT '{c}' AS \"column\", {body(c)} FROM {source}" for c in columns)


_types = {"record_id": "bigint", "age": "int", "salary": "double"}
_add(
    "profile_columns", _on("people", profile.profile_columns),
    _union(_people, lambda c: f"'{_types.get(c, 'string')}' AS dtype, count(*) AS n_rows, count(*) - count({_loaded(c)}) AS null_count, round(100.0 * (count(*) - count({_loaded(c)})) / count(*), 4) AS null_pct, count(DISTINCT {_loaded(c)}) AS n_unique", "people"), "people",
)
_add(
    "missing_report", _on("people", profile.missing_report),
    f"SELECT * FROM ({_union(_people, lambda c: f'count(*) - count({_loaded(c)}) AS missing_count, round(100.0 * (count(*) - count({_loaded(c)})) / count(*), 2) AS missing_pct', 'people')}) WHERE missing_count > 0", "people",
)


def _by_parts(df: DataFrame) -> DataFrame:
    """A profile merged from three parts, and whether its estimates are within 5 % of the exact numbers."""
    store = sketches.ProfileStore(df.sparkSession, scratch_path(df.sparkSession, "profile"))
    for i in range(3):
        store.add(df.where(F.col("record_id") % 3 == i), f"p{i}")
    exact = profile.profile_columns(df).select("column", F.col("n_unique").alias("exact"))
    near = F.abs(F.col("n_unique") - F.col("exact")) <= F.greatest(F.lit(1.0), 0.05 * F.col("exact"))
    return store.profile().join(exact, "column").select("column", "dtype", "n_rows", "null_count", "null_pct", "low", "high", near.alias("near"))


_add("profile_by_parts", _on("people", _by_parts),
     _union(_people, lambda c: f"'{_types.get(c, 'string')}' AS dtype, count(*) AS n_rows, count(*) - count({_loaded(c)}) AS null_count, round(100.0 * (count(*) - count({_loaded(c)})) / count(*), 4) AS null_pct, {f'min({c})::DOUBLE' if c in _types else 'NULL::DOUBLE'} AS low, {f'max({c})::DOUBLE' if c in _types else 'NULL::DOUBLE'} AS high, true AS near", "people"), "people")
_missing = " + ".join(f"count(*) - count({_loaded(c)})" for c in _people)
_add("completeness", _on("people", profile.completeness), f"SELECT count(*) AS n_rows, count(*) * {len(_people)} AS n_cells, {_missing} AS missing_cells, round(100.0 - 100.0 * ({_missing}) / (count(*) * {len(_people)}), 4) AS completeness FROM people", "people")
_dup_cols = [c for c in _people if c != "record_id"]
_dups = f"SELECT coalesce(sum(n - 1), 0)::BIGINT AS duplicates FROM (SELECT count(*) AS n FROM people GROUP BY {', '.join(_PROFILE.format(c) for c in _dup_cols)})"
_add("exact_dup_count", _on("people", profile.exact_duplicate_count), _dups, "people")
_add("exact_dup_rows", _on("people", profile.exact_duplicate_rows), f"SELECT * EXCLUDE (n) FROM (SELECT *, count(*) OVER (PARTITION BY {', '.join(_dup_cols)}) AS n FROM people) WHERE n > 1", "people")
_add("drop_exact_dups", _on("people", lambda df: filters.drop_exact_duplicates(df, ["record_id"])), f"SELECT * EXCLUDE (n) FROM (SELECT *, row_number() OVER (PARTITION BY {', '.join(_dup_cols)} ORDER BY record_id) AS n FROM people) WHERE n = 1", "people")
_add(
    "quality_score", _on("people", profile.quality_score),
    f"WITH c AS (SELECT count(*) AS n, {_missing} AS m FROM people), d AS ({_dups}) SELECT n AS n_rows, m AS missing_cells, duplicates, greatest(0, round(100 - 40.0 * m / (n * {len(_people)}) - 30.0 * duplicates / n, 1))::DOUBLE AS quality_score FROM c, d", "people",
)
_add("non_ascii_ratio", _on("documents", profile.non_ascii_ratio), _union(["text", "lang", "source"], lambda c: f"round(coalesce(avg(CASE WHEN regexp_matches({c}, '[^\\x00-\\x7F]') THEN 1 ELSE 0 END), 0), 6) AS non_ascii_ratio", "documents"))
_ranges = [f"\\x{{{a:04X}}}-\\x{{{b:04X}}}" for _, a, b in K.SCRIPTS]
_script = lambda c: "CASE WHEN NOT regexp_matches({0}, '[{1}]') THEN 'Latin' {2} END".format(c, "".join(_ranges), " ".join(f"WHEN regexp_matches(regexp_extract({c}, '[{''.join(_ranges)}]'), '[{r}]') THEN '{n}'" for (n, _, _), r in zip(K.SCRIPTS, _ranges, strict=True)))
_add("script_distribution", _on("documents", lambda df: profile.script_distribution(df, "text")), f"SELECT {_script('text')} AS script, count(*) AS n FROM documents GROUP BY 1")
# scripts other than Latin are made of keys, as the test texts have none
_chars = "".join(chr(a + 0x15) for _, a, _ in K.SCRIPTS)
_add(
    "script_of_mixed", _on("sales", lambda df: df.withColumn("t", F.concat(F.lit("a1 "), F.substring(F.lit(_chars), (F.col("o_orderkey") % 13 + 1).cast("int"), F.lit(2)))).groupBy(X.script_of(F.col("t")).alias("script")).agg(F.count("*").alias("n"))),
    f"SELECT {_script('t')} AS script, count(*) AS n FROM (SELECT 'a1 ' || substr('{_chars}', CAST(o_orderkey % 13 + 1 AS INT), 2) AS t FROM sales) GROUP BY 1", "sales",
)
_add("invalid_literals", _on("people", profile.invalid_literals), _union(_text, lambda c: f"count(*) FILTER (trim({c}) IN {_in(K.HEALTH_LITERALS)}) AS invalid_count", "people"), "people")
_measured = ["quantity", "price", "discount", "tax_rate", "score", "metric"]
_add("iqr_outlier_count", _on("measures", lambda df: profile.iqr_outliers(df, columns=_measured)),
     " UNION ALL ".join(f"SELECT '{c}' AS \"column\", q1, q3, (SELECT count(*) FROM measures WHERE {c} < q1 - 1.5 * (q3 - q1) OR {c} > q3 + 1.5 * (q3 - q1)) AS outliers FROM (SELECT quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.75) AS q3 FROM measures)" for c in _measured), "measures")
_add("three_sigma_count", _on("measures", lambda df: profile.three_sigma(df, _measured)),
     " UNION ALL ".join(f"SELECT '{c}' AS \"column\", (SELECT count(*) FROM measures WHERE abs({c} - m) > 3 * s) AS outliers FROM (SELECT avg({c}) AS m, stddev_samp({c}) AS s FROM measures)" for c in _measured), "measures")
_add("null_or_blank_counts", _on("people", profile.null_or_blank), _union(_people, lambda c: f"count(*) FILTER ({c} IS NULL OR trim(CAST({c} AS VARCHAR)) = '') AS null_count", "people"), "people")
_add("constant_columns", _on("people", profile.constant_columns), _union(_people, lambda c: f"count(DISTINCT {c}) AS n_distinct, count(DISTINCT {c}) = 1 AS is_constant", "people"), "people")
_rounded = lambda df, cols: df.select(*[F.round(F.col(c), 6).alias(c) if c in cols else F.col(f"`{c}`") for c in df.columns])
_stat = ["mean", "median", "std", "skew", "min", "max"]
_add("describe_numeric", _on("part", lambda df: _rounded(profile.numeric_stats(df, ["p_size", "p_retailprice"]), _stat)),
     _union(["p_size", "p_retailprice"], lambda c: f"count({c}) AS n, round(avg({c}), 6) AS mean, round(median({c}), 6) AS median, round(stddev_samp({c}), 6) AS std, round(skewness({c}), 6) AS skew, min({c})::DOUBLE AS min, max({c})::DOUBLE AS max", "part"))
_add("top_value_distribution", _on("orders", lambda df: profile.top_values(df, "o_orderpriority")), "SELECT o_orderpriority AS value, count(*) AS n, round(100.0 * count(*) / (SELECT count(*) FROM orders), 4) AS share_pct FROM orders GROUP BY 1 ORDER BY n DESC, value LIMIT 5")
_num = lambda c: f"(regexp_matches({c}, {_NUMBER}))"
_sales_text = ["priority", "customer_type", "price_text", "cost_text", "date_text", "delivery_status", "tracking_id", "order_status", "payment_status", "urgency"]
_add("mixed_types", _on("sales", profile.mixed_types), _union(_sales_text, lambda c: f"count(*) FILTER ({c} IS NOT NULL AND {_num(c)}) AS n_numeric, count(*) FILTER ({c} IS NOT NULL AND NOT {_num(c)}) AS n_text", "sales"), "sales")
_people_numbers = ["record_id", "age", "salary"]
_beyond = lambda c, t="people": f"(SELECT count(*) FROM {t}, (SELECT quantile_cont({c}, 0.25) AS a, quantile_cont({c}, 0.75) AS b FROM {t}) WHERE {c} < a - 1.5 * (b - a) OR {c} > b + 1.5 * (b - a))"
_add("table_health", _on("people", profile.health),
     f"WITH c AS (SELECT count(*) AS n, {_missing} AS m FROM people), d AS ({_dups}), o AS (SELECT {' + '.join(map(_beyond, _people_numbers))} AS k), i AS (SELECT {' + '.join(f'count(*) FILTER (trim({c}) IN {_in(K.HEALTH_LITERALS)})' for c in _text)} AS k FROM people) "
     f"SELECT n AS n_rows, m AS missing_cells, round(100.0 - 100.0 * m / (n * {len(_people)}), 4) AS completeness, duplicates, o.k AS outliers, i.k AS invalid_literals, m + duplicates + o.k + i.k AS issues, n - duplicates AS clean_rows, 3::INT AS numeric_columns, 8::INT AS text_columns, 0::INT AS other_columns FROM c, d, o, i", "people")  # fmt: skip
_sigma = lambda c: f"(SELECT count(*) FROM people, (SELECT avg({c}) AS m, stddev_samp({c}) AS s FROM people) WHERE abs({c} - m) > 3 * s)"
_add("check_all_issues", _on("people", console.check_all),
     f"WITH d AS ({_dups}), r AS (SELECT 'rows' AS \"check\", '' AS \"column\", (SELECT count(*) FROM people) AS n UNION ALL SELECT 'duplicates', '', duplicates FROM d), f AS ("
     + " UNION ALL ".join([*(f"SELECT 'nulls' AS \"check\", '{c}' AS \"column\", count(*) FILTER ({c} IS NULL OR trim(CAST({c} AS VARCHAR)) = '') AS n FROM people" for c in _people), *(f"SELECT 'outliers', '{c}', {_sigma(c)}" for c in _people_numbers), *(f"SELECT 'constant', '{c}', CASE WHEN count(DISTINCT {c}) = 1 THEN 1 ELSE 0 END FROM people" for c in _text)])
     + ") SELECT * FROM r UNION ALL SELECT * FROM f WHERE n > 0", "people")
_add("spot_check_rows", _on("orders", lambda df: profile.sample_rows(df, "o_orderkey")), "SELECT * FROM orders ORDER BY md5(CAST(o_orderkey AS VARCHAR)), o_orderkey LIMIT 5")
_add("average_null_share", _on("people", lambda df: profile.profile_columns(df).agg(F.round(F.avg("null_pct"), 4).alias("average_null_pct"))), f"SELECT round(({' + '.join(f'round(100.0 * (count(*) - count({_loaded(c)})) / count(*), 4)' for c in _people)}) / {len(_people)}, 4) AS average_null_pct FROM people", "people")
_add("preview_rows", _on("orders", lambda df: profile.preview(df, ["o_orderkey"], 20)), "SELECT * FROM orders ORDER BY o_orderkey LIMIT 20")

# ---- scalar functions -----------------------------------------------------------------------------------------------


def _scalar(name: str, table: str, key: str, out: str, run: Callable[[Column], Column], column: str, sql: str) -> None:
    _add(name, _on(table, lambda df: df.select(key, run(q(column)).alias(out))), f"SELECT {key}, {sql} AS {out} FROM {table}", table)


_clean = r"trim(regexp_replace(nfc_normalize(regexp_replace(regexp_replace({0}, '<[^>]+>', ' ', 'g'), '[\x{{200B}}-\x{{200F}}\x{{FEFF}}\x{{202A}}-\x{{202E}}]', '', 'g')), '\s+', ' ', 'g'))"
_scalar("strip_html", "pages", "page_id", "text", X.strip_html, "html", "regexp_replace(html, '<[^>]+>', ' ', 'g')")
_scalar("clean_string", "documents", "doc_id", "cleaned", X.clean_string, "text", f"CASE WHEN {_clean.format('text')} NOT IN {_in(K.CLEAN_MARKERS)} THEN {_clean.format('text')} END")
_scalar("title_case", "people", "record_id", "titled", X.title_case, "full_name", _TITLE.format("full_name"))
_scalar("upper_strip", "people", "record_id", "uppered", X.upper_strip, "segment", "upper(trim(segment))")
_std = lambda c: f"CASE WHEN upper(trim({c})) IN {_in(K.CASE_ACRONYMS)} THEN upper(trim({c})) WHEN trim({c}) <> '' THEN {_TITLE.format(f'trim({c})')} END"
_scalar("standard_case", "sales", "o_orderkey", "cased", X.standard_case, "customer_type", _std("customer_type"))
_scalar("normalize_email", "people", "record_id", "clean_email", X.normalize_email, "email", r"nullif(regexp_extract(regexp_replace(regexp_replace(lower(trim(email)), '\s+at\s+|\.at\.', '@', 'g'), '\s+', '', 'g'), '[a-z0-9._%+\-]+@[a-z0-9.\-]+\.[a-z]{2,}'), '')")
_phone = _NATIONAL.format("phone")
_scalar("normalize_phone", "people", "record_id", "clean_phone", X.normalize_phone, "phone", f"CASE WHEN length({_phone}) BETWEEN 7 AND 15 AND replace({_phone}, left({_phone}, 1), '') <> '' THEN {_phone} END")
_scalar("dedup_phone", "people", "record_id", "key_phone", X.dedup_phone, "phone", f"CASE WHEN length({_phone}) >= 7 THEN {_phone} ELSE '' END")
_scalar("dedup_key", "people", "record_id", "key_city", X.dedup_key, "city", _KEY.format("city"))
_scalar("coerce_numeric_abs", "sales", "o_orderkey", "cost", lambda c: N.coerce_numeric(c, "cost_text"), "cost_text", f"abs(CASE WHEN {_num('cost_text')} THEN CAST(trim(cost_text) AS DOUBLE) END)")
_scalar("fix_boolean", "people", "record_id", "flag", X.fix_boolean, "active", "CASE WHEN lower(trim(active)) IN ('yes', 'y', 'true', '1', 't', 'on') THEN true WHEN lower(trim(active)) IN ('no', 'n', 'false', '0', 'f', 'off') THEN false END")
_date = "CASE WHEN regexp_matches(date_text, '^\\d{4}[-/]\\d{2}[-/]\\d{2}') THEN replace(left(date_text, 10), '/', '-') END"
_scalar("parse_dates_iso", "sales", "o_orderkey", "iso", N.iso_date, "date_text", _date)
# dates whose order of day and month only the whole column tells: by customer, one column each way
_dated = "SELECT o_orderkey, {fmt}(order_date, '{d}') AS day_first, {fmt}(order_date, '{m}') AS month_first, CASE WHEN o_orderkey % 5 = 0 THEN 'soon' ELSE {fmt}(delivery_date, '{x}') END AS dotted FROM {t}"
_dated_spark, _dated_sql = _dated.format(fmt="date_format", d="dd/MM/yyyy", m="MM-dd-yyyy", x="d.M.yyyy", t="{t}"), _dated.format(fmt="strftime", d="%d/%m/%Y", m="%m-%d-%Y", x="%-d.%-m.%Y", t="sales")
_dates_of = lambda df: df.sparkSession.sql(_dated_spark, t=df)
_date_columns = ["day_first", "month_first", "dotted"]
_vote = lambda c, g: f"TRY_CAST(regexp_extract({c}, '^(\\d{{1,2}})([/.-])(\\d{{1,2}})[/.-](\\d{{4}})$', {g}) AS INT)"
_add("date_format_votes", _on("sales", lambda df: dates.votes(_dates_of(df), _date_columns)),
     f"WITH d AS ({_dated_sql}) " + " UNION ALL ".join(f"SELECT '{c}' AS \"column\", s AS separator, count(*) AS n, count(*) FILTER (a > 12 AND b <= 12) AS day_first, count(*) FILTER (b > 12 AND a <= 12) AS month_first FROM (SELECT regexp_extract({c}, '^(\\d{{1,2}})([/.-])(\\d{{1,2}})[/.-](\\d{{4}})$', 2) AS s, {_vote(c, 1)} AS a, {_vote(c, 3)} AS b FROM d) WHERE s <> '' GROUP BY s" for c in _date_columns), "sales")
_add("parse_dates_by_column", _on("sales", lambda df: dates.parse(_dates_of(df), _date_columns)), "SELECT o_orderkey, CAST(order_date AS VARCHAR) AS day_first, CAST(order_date AS VARCHAR) AS month_first, CASE WHEN o_orderkey % 5 <> 0 THEN CAST(delivery_date AS VARCHAR) END AS dotted FROM sales", "sales")
_map = "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in K.CURRENCY_OF.items()) + "}"
_rates = "MAP {" + ", ".join(f"'{k}': {v}" for k, v in K.RUPEES.items()) + "}"
_money_re = K.MONEY.replace("'", "''")
_money = f"""WITH m AS (SELECT o_orderkey, price_text, regexp_extract(trim(price_text), '{_money_re}', 1) AS s1, replace(regexp_extract(trim(price_text), '{_money_re}', 2), ',', '') AS num, regexp_extract(trim(price_text), '{_money_re}', 3) AS s2 FROM sales),
p AS (SELECT o_orderkey, price_text, CASE WHEN regexp_matches(num, {_NUMBER}) THEN CAST(num AS DOUBLE) END AS amount, coalesce({_map}[lower(trim(s1))], {_map}[lower(trim(s2))]) AS c FROM m),
r AS (SELECT o_orderkey, price_text, amount, CASE WHEN amount IS NOT NULL THEN c END AS code FROM p) """
_add("parse_money", _on("sales", lambda df: df.select("o_orderkey", N.parse_money(F.col("price_text")).alias("m")).select("o_orderkey", "m.amount", "m.code")), _money + "SELECT o_orderkey, amount, code FROM r", "sales")
_add("convert_currency", _on("sales", lambda df: currency.convert(df.select("o_orderkey", "price_text"))), _money + f"SELECT o_orderkey, round(amount * coalesce({_rates}[code], 1.0), 2) AS price_text FROM r", "sales")
_add("currency_report", _on("sales", lambda df: currency.report(df, ["price_text"])), _money + "SELECT 'price_text' AS \"column\", CASE WHEN amount IS NULL THEN 'FAILED' ELSE coalesce(code, 'UNKNOWN') END AS currency, count(*) AS n FROM r WHERE price_text IS NOT NULL GROUP BY 2", "sales")
_add("load_markers", _on("people", lambda df: df.select("record_id", *[X.load_missing(q(c)).alias(c) for c in ("phone", "city", "email")])), "SELECT record_id, " + ", ".join(f"{_LOADED.format(c)} AS {c}" for c in ("phone", "city", "email")) + " FROM people", "people")

# ---- filters and rules ----------------------------------------------------------------------------------------------

_nn = lambda cols: " + ".join(f"CASE WHEN {c} IS NULL THEN 0 ELSE 1 END" for c in cols)
_add("drop_sparse_columns", _on("people", lambda df: filters.drop_sparse_columns(df.withColumn("mostly_empty", F.when(F.col("record_id") % 100 == 0, "x")))), "SELECT * EXCLUDE (mostly_empty) FROM people", "people")
_sparse = ["pan", "salary", "mostly_empty", "full_name"]
_add("drop_sparse_rows", _on("people", lambda df: filters.drop_sparse_rows(df.select(*_sparse))), f"SELECT {', '.join(_sparse)} FROM people WHERE {_nn(_sparse)} >= 2", "people")
_crit = ["full_name", "email", "phone", "city"]
_crit_frame = lambda df: df.select("record_id", *[X.load_missing(q(c)).alias(c) for c in _crit])
_crit_sql = "(SELECT record_id, " + ", ".join(f"{_LOADED.format(c)} AS {c}" for c in _crit) + " FROM people)"
_add("critical_fields", _on("people", lambda df: filters.critical_filter(_crit_frame(df))), f"SELECT * FROM {_crit_sql} WHERE {_nn(_crit)} >= 3", "people")
_dummy = K.DUMMY_VALUE.replace("'", "''")
_add("dummy_rows", _on("people", lambda df: filters.dummy_filter(df.select("record_id", *_crit), _crit)), f"SELECT record_id, {', '.join(_crit)} FROM people WHERE " + " + ".join(f"CASE WHEN regexp_matches(lower(trim({c})), '{_dummy}') THEN 1 ELSE 0 END" for c in _crit) + " < 2", "people")
_add("missing_targets", _on("people", lambda df: filters.drop_missing_targets(df, ["salary"])), "SELECT * FROM people WHERE salary IS NOT NULL", "people")
_add("temporal_paradox_swap", _on("sales", lambda df: rules.swap_paradox(df.select("o_orderkey", "order_date", "delivery_date"), "order_date", "delivery_date")), "SELECT o_orderkey, least(order_date, delivery_date) AS order_date, greatest(order_date, delivery_date) AS delivery_date FROM sales", "sales")


def _domain(name: str, table: str, keys: list[str], columns: dict[str, str]) -> None:
    key = name.lower().replace("-", "")
    _add(f"domain_rules_{key}", _on(table, lambda df: rules.domain_rules(df.select(*keys, *columns), name)), f"SELECT {', '.join([*keys, *(f'{v} AS {c}' for c, v in columns.items())])} FROM {table}", table)


_between = lambda c, a, b=None: f"CASE WHEN {c} >= {a}" + (f" AND {c} <= {b}" if b is not None else "") + f" THEN {c} END"
_line = ["l_orderkey", "l_linenumber"]
_domain("Retail", "sales", ["o_orderkey", "customer_type"], {"priority": "CASE WHEN upper(trim(customer_type)) IN ('B2B', 'B2C') AND (priority IS NULL OR trim(priority) IN ('', 'nan', 'None')) THEN 'Medium' ELSE priority END"})
_domain("Finance", "sales", ["o_orderkey", "order_status"], {"total_amount": "greatest(total_amount, 0)", "payment_status": "CASE WHEN payment_status IS NULL AND lower(order_status) = 'delivered' THEN 'Paid' ELSE payment_status END"})
_domain("Logistics", "sales", ["o_orderkey", "tracking_id"], {"delivery_status": "CASE WHEN trim(tracking_id) <> '' AND (delivery_status IS NULL OR trim(delivery_status) = '') THEN 'In Transit' ELSE delivery_status END"})
_domain("Healthcare", "measures", _line, {"age": _between("age", 0, 150), "bmi": _between("bmi", 10, 70), "blood_pressure": _between("blood_pressure", 60, 250)})
_domain("HR", "measures", _line, {"salary": _between("salary", 0)})
_domain("E-Commerce", "measures", _line, {"price": _between("price", 0), "rating": _between("rating", 0, 5)})
_domain("Manufacturing", "measures", _line, {"quantity": _between("quantity", 0), "yield_kg": _between("yield_kg", 0)})
_domain("Agriculture", "measures", _line, {"yield_kg": _between("yield_kg", 0)})
_domain("Education", "measures", _line, {"gpa": _between("gpa", 0, 10), "marks": _between("marks", 0, 100), "score": _between("score", 0, 100)})
_domain("Telecommunications", "measures", _line, {"call_duration": _between("call_duration", 0)})

# ---- imputation, outliers, validation -------------------------------------------------------------------------------

_gap = f"(CASE WHEN lower(trim({{0}})) NOT IN {_in(K.IMPUTE_MARKERS)} THEN {{0}} END)"
_add("fill_none", _on("people", lambda df: impute.fill(df.select("record_id", "phone"), "phone", "fill_none")), f"SELECT record_id, {_gap.format('phone')} AS phone FROM people", "people")
for _how, _f in (("mean", "avg"), ("median", "median"), ("knn", "median")):
    _add(f"fill_{_how}", _on("sales", lambda df, how=_how: _rounded(impute.fill(df.select("o_orderkey", "gap_amount"), "gap_amount", f"fill_{how}"), ["gap_amount"])), f"SELECT o_orderkey, round(coalesce(gap_amount, (SELECT {_f}(gap_amount) FROM sales)), 6) AS gap_amount FROM sales", "sales")
_add("fill_mode", _on("sales", lambda df: impute.fill(df.select("o_orderkey", "priority"), "priority", "fill_mode")), "SELECT o_orderkey, coalesce(priority, (SELECT priority FROM sales WHERE priority IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, priority LIMIT 1)) AS priority FROM sales", "sales")
_add("fill_constant", _on("sales", lambda df: impute.fill(df.select("o_orderkey", "priority"), "priority", "fill_constant")), "SELECT o_orderkey, coalesce(priority, 'Unknown') AS priority FROM sales", "sales")
_add("fill_forward", _on("sales", lambda df: impute.fill(df.select("o_orderkey", "gap_amount"), "gap_amount", "fill_forward", ["o_orderkey"])), "SELECT o_orderkey, last_value(gap_amount IGNORE NULLS) OVER (ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS gap_amount FROM sales", "sales")
_add("fill_backward", _on("sales", lambda df: impute.fill(df.select("o_orderkey", "gap_amount"), "gap_amount", "fill_backward", ["o_orderkey"])), "SELECT o_orderkey, first_value(gap_amount IGNORE NULLS) OVER (ORDER BY o_orderkey ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS gap_amount FROM sales", "sales")
_add(
    "fill_interpolate", _on("sales", lambda df: _rounded(impute.fill(df.select("o_orderkey", "gap_amount"), "gap_amount", "fill_interpolate", ["o_orderkey"]), ["gap_amount"])),
    """WITH n AS (SELECT o_orderkey, gap_amount AS v, row_number() OVER (ORDER BY o_orderkey) AS i FROM sales),
    w AS (SELECT *, last_value(v IGNORE NULLS) OVER a AS pv, last_value(CASE WHEN v IS NOT NULL THEN i END IGNORE NULLS) OVER a AS pi, first_value(v IGNORE NULLS) OVER b AS nv, first_value(CASE WHEN v IS NOT NULL THEN i END IGNORE NULLS) OVER b AS ni FROM n
      WINDOW a AS (ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), b AS (ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
    SELECT o_orderkey, round(coalesce(v, CASE WHEN ni > pi THEN pv + (nv - pv) * (i - pi) / (ni - pi) END, pv, nv), 6) AS gap_amount FROM w""", "sales",
)
_gappy = "SELECT l_orderkey, l_linenumber, CAST(CASE WHEN l_orderkey % 200 = 3 THEN NULL ELSE round(quantity) END AS DOUBLE) AS quantity, CAST(CASE WHEN l_orderkey % 320 IN (5, 163) THEN NULL ELSE floor(price / 100) END AS DOUBLE) AS price, CAST(CASE WHEN l_orderkey % 300 IN (1, 3) THEN NULL ELSE round(tax_rate * 100) END AS DOUBLE) AS tax FROM {0}"
_near = ["quantity", "price", "tax"]
_apart = " + ".join(f"CASE WHEN g.{c} IS NULL OR u.{c} IS NULL THEN 0 ELSE (g.{c} - u.{c}) * (g.{c} - u.{c}) END" for c in _near)
_common = " + ".join(f"CASE WHEN g.{c} IS NULL OR u.{c} IS NULL THEN 0 ELSE 1 END" for c in _near)
_nearest = ", ".join(f"n_{f} AS (SELECT r, list_avg(list_transform(min(struct_pack(d := ({_apart}) * 3 / ({_common}), x := u.{f}), 5), lambda s: s.x)) AS x FROM g JOIN u ON u.{f} IS NOT NULL AND ({_common}) > 0 WHERE g.{f} IS NULL GROUP BY r)" for f in _near)
_filled = ", ".join(f"round(coalesce(u.{f}, n_{f}.x, (SELECT avg({f}) FROM u)), 6) AS {f}" for f in _near)
_add("knn_impute", _on("measures", lambda df: _rounded(impute.knn(df.sparkSession.sql(_gappy.format("{m}"), m=df), _near), _near)),
     f"""WITH u AS MATERIALIZED ({_gappy.format('measures')}), g AS MATERIALIZED (SELECT row_number() OVER () AS r, * FROM (SELECT DISTINCT {', '.join(_near)} FROM u WHERE {' OR '.join(f'{c} IS NULL' for c in _near)})), {_nearest}
    SELECT l_orderkey, l_linenumber, {_filled} FROM u LEFT JOIN g ON {' AND '.join(f'u.{c} IS NOT DISTINCT FROM g.{c}' for c in _near)} {' '.join(f'LEFT JOIN n_{f} ON n_{f}.r = g.r' for f in _near)}""", "measures")  # fmt: skip
_rules = [ImputationRule("priority", "customer_type == 'B2B'", "Medium", 90), ImputationRule("priority", "total_amount > 200000", "1-URGENT", 60), ImputationRule("priority", "order_status != 'open'", "Low", 40)]
_add("smart_rules", _on("sales", lambda df: impute.apply_rules(df.select("o_orderkey", "customer_type", "total_amount", "order_status", "priority"), _rules)),
     "SELECT o_orderkey, customer_type, total_amount, order_status, CASE WHEN priority IS NOT NULL THEN priority WHEN lower(trim(customer_type)) = 'b2b' THEN 'Medium' WHEN total_amount > 200000 THEN '1-URGENT' WHEN lower(trim(order_status)) <> 'open' THEN 'Low' END AS priority FROM sales", "sales")
_clipped = lambda c, lo, hi: f"least(greatest({c}, {lo}), {hi})"
_add("clip_iqr", _on("measures", lambda df: _rounded(outliers.clip_all(df.select(*_line, "metric"), outliers.iqr_bounds(df, ["metric"])), ["metric"])),
     f"SELECT l_orderkey, l_linenumber, round({_clipped('metric', 'a - 1.5 * (b - a)', 'b + 1.5 * (b - a)')}, 6) AS metric FROM measures, (SELECT quantile_cont(metric, 0.25) AS a, quantile_cont(metric, 0.75) AS b FROM measures)", "measures")
_add("clip_zscore", _on("measures", lambda df: _rounded(outliers.clip_all(df.select(*_line, "metric"), outliers.z_bounds(df, ["metric"], 1.5)), ["metric"])),
     f"SELECT l_orderkey, l_linenumber, round({_clipped('metric', 'm - 1.5 * s', 'm + 1.5 * s')}, 6) AS metric FROM measures, (SELECT avg(metric) AS m, stddev_samp(metric) AS s FROM measures)", "measures")
_add("cap_domain", _on("measures", lambda df: _rounded(outliers.cap_domain(df.select(*_line, "score"), {"score": (0, 100)}), ["score"])),
     f"WITH r AS (SELECT l_orderkey, l_linenumber, CASE WHEN score < 0 OR score > 100 THEN (SELECT median(score) FROM measures) ELSE score END AS score FROM measures), b AS (SELECT quantile_cont(score, 0.25) AS a, quantile_cont(score, 0.75) AS b FROM r) SELECT l_orderkey, l_linenumber, round({_clipped('score', 'a - 1.5 * (b - a)', 'b + 1.5 * (b - a)')}, 6) AS score FROM r, b", "measures")
_method = lambda c: "any_value('domain_cap')" if outliers.bounds_for(c) else f"CASE WHEN count({c}) < 4 OR abs(skewness({c})) > 1 THEN 'iqr' ELSE 'zscore' END"
_add("outlier_plan", _on("measures", lambda df: df.sparkSession.createDataFrame(list(outliers.choose_methods(df, _measured).items()), "column string, method string")), _union(_measured, lambda c: f"{_method(c)} AS method", "measures"), "measures")
_add("treat_outliers", _on("measures", lambda df: _rounded(outliers.treat_outliers(df.select(*_line, "quantity", "score", "metric"), "", columns=["quantity", "score", "metric"])[0], ["quantity", "score", "metric"])),
     f"""WITH r AS (SELECT l_orderkey, l_linenumber, CASE WHEN quantity < 0 THEN (SELECT median(quantity) FROM measures) ELSE quantity END AS quantity, CASE WHEN score < 0 OR score > 100 THEN (SELECT median(score) FROM measures) ELSE score END AS score, metric FROM measures),
    b AS (SELECT quantile_cont(quantity, 0.25) AS qa, quantile_cont(quantity, 0.75) AS qb, quantile_cont(score, 0.25) AS sa, quantile_cont(score, 0.75) AS sb, quantile_cont(metric, 0.25) AS ma, quantile_cont(metric, 0.75) AS mb, avg(metric) AS m, stddev_samp(metric) AS s, abs(skewness(metric)) > 1 AS k FROM r)
    SELECT l_orderkey, l_linenumber, round({_clipped('quantity', 'qa - 1.5 * (qb - qa)', 'qb + 1.5 * (qb - qa)')}, 6) AS quantity, round({_clipped('score', 'sa - 1.5 * (sb - sa)', 'sb + 1.5 * (sb - sa)')}, 6) AS score,
      round({_clipped('metric', 'CASE WHEN k THEN ma - 1.5 * (mb - ma) ELSE m - 3 * s END', 'CASE WHEN k THEN mb + 1.5 * (mb - ma) ELSE m + 3 * s END')}, 6) AS metric FROM r, b""", "measures")  # fmt: skip
_part = "(SELECT unnest(list_filter(list_transform(string_split({0}, ','), lambda x: trim(x)), lambda x: x <> '')) AS x FROM people)"
_email_bad = f"CASE WHEN regexp_matches(x, '{K.DUMMY_EMAIL}') THEN 'placeholder' WHEN NOT regexp_matches(x, '{K.VALID_EMAIL}') THEN 'invalid' END"
_d = "regexp_replace(x, '\\D', '', 'g')"
_phone_bad = f"CASE WHEN {_d} = '' THEN 'no digits' WHEN replace({_d}, left({_d}, 1), '') = '' THEN 'same digit' WHEN NOT regexp_matches(x, '^\\+?\\d+$') THEN 'characters' WHEN length({_d}) NOT BETWEEN 7 AND 15 THEN 'length' END"
_add("validate_email", _on("people", lambda df: validate.problems(df, "email", "email")), f"SELECT problem, count(*) AS n FROM (SELECT {_email_bad} AS problem FROM {_part.format('email')}) WHERE problem IS NOT NULL GROUP BY 1", "people")
_add("validate_phone", _on("people", lambda df: validate.problems(df, "phone", "phone")), f"SELECT problem, count(*) AS n FROM (SELECT {_phone_bad} AS problem FROM {_part.format('phone')}) WHERE problem IS NOT NULL GROUP BY 1", "people")
_neg = ["quantity", "price", "discount", "tax_rate", "age", "salary", "profit_amount"]
_add("validate_numeric", _on("measures", lambda df: validate.negatives(df.select(*_neg))), _union(_neg, lambda c: f"count(*) FILTER ({c} < 0) AS n", "measures"), "measures")
_add("validate_temporal", _on("sales", lambda df: validate.paradoxes(df, "order_date", "delivery_date")), "SELECT count(*) FILTER (delivery_date < order_date) AS paradoxes FROM sales", "sales")
_add("validate_discount", _on("measures", lambda df: validate.excess_discounts(df, "discount")), "SELECT count(*) FILTER (discount > 100) AS excess FROM measures", "measures")
_add("validate_sentinel", _on("measures", lambda df: validate.sentinels(df, ["metric", "quantity", "discount"])), _union(["metric", "quantity", "discount"], lambda c: f"count(*) FILTER ({c} IN (-100, -999, -1, -9999)) AS n", "measures"), "measures")
_kinds = {"full_name": "Name", "email": "Email", "phone": "Phone", "city": "Location", "age": "Numeric", "segment": "Categorical", "mostly_empty": "Categorical"}


def _score(c: str) -> str:
    kind, text = _kinds[c], c not in ("age",)
    parts = ["100.0"]
    if kind in ("Categorical", "Name"):
        parts.append(f"least(50, 100 * coalesce(avg(CASE WHEN regexp_matches({c}, '[^\\x00-\\x7F]') THEN 1.0 ELSE 0 END), 0))")
    parts.append(f"CASE WHEN (count(*) - count({c})) > 0.5 * count(*) THEN 20 ELSE 0 END")
    if text:
        parts.append(f"CASE WHEN count(*) FILTER (trim({c}) = '') > 0 THEN 10 ELSE 0 END")
    if kind in ("Email", "Phone"):
        parts.append(f"least(40, 5 * (SELECT count(*) FROM {_part.format(c)} WHERE {_email_bad if kind == 'Email' else _phone_bad} IS NOT NULL))")
    if c == "age":
        parts.append(f"CASE WHEN count(*) FILTER ({c} < 0) > 0 THEN 3 ELSE 0 END")
    return f"'{kind}' AS semantic_type, greatest(0, round({' - '.join(parts)}, 4))::DOUBLE AS score"


_add("overall_score", _on("people", lambda df: df.sparkSession.createDataFrame([(float(validate.validate(df.select(*_kinds), _kinds)[0]),)], "overall double")), f"SELECT round(avg(score), 1) AS overall FROM ({_union(list(_kinds), _score, 'people')})", "people")
_add("validation_score", _on("people", lambda df: validate.column_scores(df.select(*_kinds), _kinds)), _union(list(_kinds), _score, "people"), "people")

# ---- classification -------------------------------------------------------------------------------------------------

_values = lambda names, rows: f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(str, r)) + ')' for r in rows)}) AS v({names})"
_semantic = [("record_id", "ID_Code", 0.90, "fill_none"), ("full_name", "Name", 0.95, "fill_none"), ("email", "Email", 0.95, "fill_none"), ("phone", "Phone", 0.95, "fill_none"), ("city", "Location", 0.90, "fill_none"),
             ("pan", "Structured_ID", 0.92, "fill_none"), ("age", "Numeric", 0.85, "fill_median"), ("salary", "Numeric", 0.85, "fill_none"), ("segment", "Categorical", 0.80, "fill_mode"), ("active", "Categorical", 0.80, "fill_mode"), ("mostly_empty", "Categorical", 0.80, "fill_mode")]
_add("semantic_types", _on("people", lambda df: classify.semantic_types(df, ["record_id"])), _values('"column", semantic_type, confidence, imputation', [(f"'{a}'", f"'{b}'", f"{c}::DOUBLE", f"'{i}'") for a, b, c, i in _semantic]), "people")
_normal = {"ID_Code": ("uppercase_strip", "none"), "Name": ("title_case", "fuzzy_name"), "Email": ("normalize_email", "none"), "Phone": ("normalize_phone", "none"), "Location": ("title_case", "blocking_key"), "Structured_ID": ("uppercase_strip", "none"), "Numeric": ("coerce_numeric", "none"), "Categorical": ("standardize_case", "none")}
_add("cleaning_plan", _on("people", lambda df: df.sparkSession.createDataFrame([(c, s.imputation, s.normalization, s.deduplication) for c, s in plan(classify.infer_schema(df, ["record_id"])).items()], "column string, imputation string, normalization string, deduplication string")),
     _values('"column", imputation, normalization, deduplication', [(f"'{a}'", f"'{i}'", *(f"'{x}'" for x in _normal[b])) for a, b, c, i in _semantic]), "people")
_sales_cols = ["o_orderkey", "o_custkey", "total_amount", "gap_amount", *_sales_text, "order_date", "delivery_date"]
_domains = f"""WITH names AS (SELECT unnest({_sales_cols}) AS c), head AS (SELECT * FROM sales ORDER BY o_orderkey LIMIT 20), vals AS ({' UNION ALL '.join(f'SELECT lower({c}) AS v FROM head' for c in _sales_text)}),
    words AS ({' UNION ALL '.join(f"SELECT '{d}' AS domain, unnest({w}) AS w" for d, w in classify.domain_words().items())}), n AS (SELECT DISTINCT domain, c FROM words, names WHERE contains(c, w)), v AS (SELECT domain, count(*) AS k FROM (SELECT domain, v, bool_or(contains(v, w)) AS hit FROM words, (SELECT v, row_number() OVER () AS i FROM vals WHERE v IS NOT NULL) GROUP BY domain, v, i) WHERE hit GROUP BY domain)
    SELECT domain, (SELECT count(*) FROM n WHERE n.domain = d.domain) + 0.5::DOUBLE * coalesce((SELECT k FROM v WHERE v.domain = d.domain), 0) AS score FROM (SELECT DISTINCT domain FROM words) d"""
_add("domain_scores", _on("sales", lambda df: classify.domain_scores(df.select(*_sales_cols), ["o_orderkey"])), _domains, "sales")
# of all values of the table
_all_domains = f"WITH vals AS ({' UNION ALL '.join(f'SELECT lower({c}) AS v FROM sales' for c in _sales_text)}) " + " UNION ALL ".join(
    f"SELECT '{d}' AS domain, {sum(any(w in c for w in ws) for c in _sales_cols)}::DOUBLE + 0.5::DOUBLE * count(*) FILTER ({' OR '.join(f"contains(v, '{w}')" for w in ws)}) AS score FROM vals" for d, ws in classify.domain_words().items())
_add("top_domains", _on("sales", lambda df: audit.top_domains(classify.domain_scores(df.select(*_sales_cols), ["o_orderkey"], first_rows=None))), f"SELECT * FROM ({_all_domains.replace('WITH vals AS', 'WITH vals AS MATERIALIZED', 1)}) ORDER BY score DESC, domain LIMIT 5", "sales")
_add("type_histogram", _on("people", lambda df: audit.type_histogram(df.sparkSession, classify.infer_schema(df, ["record_id"]))), f"SELECT semantic_type, count(*) AS n FROM ({_values('name, semantic_type', [(f"'{a}'", f"'{b}'") for a, b, *_ in _semantic])}) GROUP BY 1", "people")
_steps = "SELECT CASE WHEN o_orderkey % 3 = 0 THEN 'fill' ELSE 'case' END AS step, CAST(o_orderkey % 3 AS INT) AS step_number, 'priority' AS \"column\", CAST(o_custkey % 5 AS VARCHAR) AS task, trim(customer_type) AS original, upper(trim(customer_type)) AS cleaned, 'e' AS explanation, CASE WHEN o_orderkey % 4 = 0 THEN 'info' WHEN o_orderkey % 4 = 1 THEN 'fix' ELSE 'change' END AS severity FROM sales"
_entries = lambda df: df.selectExpr("CASE WHEN o_orderkey % 3 = 0 THEN 'fill' ELSE 'case' END AS step", "CAST(o_orderkey % 3 AS INT) AS step_number", "'priority' AS column", "CAST(o_custkey % 5 AS STRING) AS task", "trim(customer_type) AS original", "upper(trim(customer_type)) AS cleaned", "'e' AS explanation", "CASE WHEN o_orderkey % 4 = 0 THEN 'info' WHEN o_orderkey % 4 = 1 THEN 'fix' ELSE 'change' END AS severity")
_add("audit_by_step", _on("sales", lambda df: audit.by_step(_entries(df))), f"SELECT step_number, step, count(*) AS entries, count(*) FILTER (severity IN ('change', 'fix', 'remove')) AS changes FROM ({_steps}) GROUP BY 1, 2", "sales")
_add("audit_distinct_changes", _on("sales", lambda df: audit.distinct_changes(_entries(df)).select("original", "cleaned", "step_number", "task")), f"SELECT original, cleaned, step_number, task FROM ({_steps}) QUALIFY row_number() OVER (PARTITION BY original, cleaned ORDER BY step_number, \"column\", task) = 1", "sales")
# the first two stages of a cleaning run, compared cell by cell with what they were given
_keyed_text = lambda c: f"CASE WHEN {_clean.format(c)} NOT IN {_in(K.CLEAN_MARKERS)} THEN {_clean.format(c)} END"
_stages = lambda df: (df, loaded := pipeline.loaded(df), pipeline.clean_texts(loaded, ["record_id"]))
_diff = " UNION ALL ".join(f"SELECT 1 AS step_number, 'load' AS step, '{c}' AS \"column\", {c} AS original, {_loaded(c)} AS cleaned, record_id FROM people WHERE {c} IS DISTINCT FROM {_loaded(c)} UNION ALL SELECT 5, 'text', '{c}', {_loaded(c)}, {_keyed_text(_loaded(c))}, record_id FROM people WHERE {_loaded(c)} IS DISTINCT FROM {_keyed_text(_loaded(c))}" for c in _text)
_counts = f"SELECT step_number, step, \"column\", original, cleaned, count(*) AS n, CAST(min(record_id) AS VARCHAR) AS example FROM ({_diff}) GROUP BY ALL"


def _changes(df: DataFrame) -> DataFrame:
    raw, loaded, cleaned = _stages(df)
    return audit.change_counts(raw, loaded, ["record_id"], 1, "load").union(audit.change_counts(loaded, cleaned, ["record_id"], 5, "text"))


_add("audit_changes", _on("people", _changes), _counts, "people")
_add("audit_column_totals", _on("people", lambda df: audit.column_totals(_changes(df))), f"SELECT step_number, step, \"column\", sum(n)::BIGINT AS cells, count(*) AS kinds, coalesce(sum(n) FILTER (cleaned IS NULL), 0)::BIGINT AS emptied, coalesce(sum(n) FILTER (original IS NULL), 0)::BIGINT AS filled FROM ({_counts}) GROUP BY 1, 2, 3", "people")
_add("audit_top_changes", _on("people", lambda df: audit.top_changes(_changes(df))), f"SELECT *, row_number() OVER (PARTITION BY step, \"column\" ORDER BY n DESC, original NULLS FIRST, cleaned NULLS FIRST) AS place FROM ({_counts}) QUALIFY place <= 5", "people")
_links = {"nation": ["region"], "customer": ["nation"], "supplier": ["nation"], "orders": ["customer"], "lineitem": ["orders", "part", "supplier"]}
_add("table_levels", lambda s, d: s.createDataFrame(list(classify.levels(["region", "nation", "customer", "supplier", "part", "orders", "lineitem"], _links).items()), "table_name string, level int"),
     f"WITH RECURSIVE e AS ({' UNION ALL '.join(f"SELECT '{a}' AS a, unnest({b}) AS b" for a, b in _links.items())}), w AS (SELECT unnest(['region', 'nation', 'customer', 'supplier', 'part', 'orders', 'lineitem']) AS t, 0 AS level UNION ALL SELECT a, level + 1 FROM w JOIN e ON b = t) SELECT t AS table_name, max(level)::INT AS level FROM w GROUP BY t")
_add("dataset_intent", lambda s, d: s.createDataFrame([(t, classify.intent_of(frame(s, d, t)), classify.is_time_series(frame(s, d, t).columns)) for t in ("people", "sales", "events", "labels")], "table_name string, intent string, time_series boolean"),
     _values("table_name, intent, time_series", [("'people'", "'Non-Predictive Business'", "false"), ("'sales'", "'Non-Predictive Business'", "true"), ("'events'", "'Non-Predictive Business'", "false"), ("'labels'", "'Predictive'", "false")]))
_all = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "labels", "conversations"]
_strip = lambda s, d: {t: [c.split("_", 1)[1] if t in _all[:7] else c for c in frame(s, d, t).columns] for t in _all}
_add("relationships_inferred", lambda s, d: s.createDataFrame(classify.relations(_strip(s, d)), "from_table string, from_col string, to_table string, to_col string, type string"),
     """WITH c AS (SELECT table_name AS t, CASE WHEN table_name IN ('region', 'nation', 'customer', 'supplier', 'part', 'orders', 'lineitem') THEN substr(column_name, strpos(column_name, '_') + 1) ELSE column_name END AS c FROM information_schema.columns
      WHERE table_name IN ('region', 'nation', 'customer', 'supplier', 'part', 'orders', 'lineitem', 'events', 'documents', 'labels', 'conversations')),
    o AS (SELECT * FROM (VALUES ('region', 1), ('nation', 2), ('customer', 3), ('supplier', 4), ('part', 5), ('orders', 6), ('lineitem', 7), ('events', 8), ('documents', 9), ('labels', 10), ('conversations', 11)) AS v(t, i))
    SELECT a.t AS from_table, a.c AS from_col, b.t AS to_table, b.c AS to_col, 'Inferred' AS type FROM c a JOIN o oa ON a.t = oa.t JOIN c b ON a.c = b.c JOIN o ob ON b.t = ob.t WHERE oa.i < ob.i AND regexp_matches(lower(a.c), 'id|key|code|ref|no')""")  # fmt: skip

# ---- mapping, fuzzy, deduplication ----------------------------------------------------------------------------------

_add("canonical_categories", _on("people", lambda df: mapping.apply_map(df.select("record_id", "segment"), "segment", mapping.categorical_map(df, "segment"))), f"SELECT record_id, {_TITLE.format('lower(trim(segment))')} AS segment FROM people", "people")
_add("transliterate_names", _on("people", lambda df: mapping.apply_map(df.select("record_id", "full_name"), "full_name", mapping.name_map(df, "full_name"))), r"SELECT record_id, " + _TITLE.format(r"regexp_replace(trim(full_name), '\s+', ' ', 'g')") + " AS full_name FROM people", "people")
_accented = lambda df: df.select("record_id", F.when(F.col("record_id") % 3 == 0, F.translate("full_name", "aeu", "áéü")).otherwise(F.col("full_name")).alias("full_name"))
_add("transliterate_accents", _on("people", lambda df: mapping.apply_map(_accented(df), "full_name", mapping.name_map(_accented(df), "full_name"))),
     r"SELECT record_id, CASE WHEN regexp_matches(n, '[^\x00-\x7F]') THEN strip_accents(trim(n)) ELSE " + _TITLE.format(r"regexp_replace(trim(n), '\s+', ' ', 'g')") + " END AS full_name FROM (SELECT record_id, CASE WHEN record_id % 3 = 0 THEN translate(full_name, 'aeu', 'áéü') ELSE full_name END AS n FROM people)", "people")
_spelled = lambda values: {v: v.replace("Ü", "UE").replace("ü", "ue").upper() for v in values}
_umlauts = lambda df: df.select("record_id", F.when(F.col("record_id") % 2 == 0, F.translate("segment", "Uu", "Üü")).otherwise(F.col("segment")).alias("segment"))
_add("translated_categories", _on("people", lambda df: mapping.apply_map(_umlauts(df), "segment", mapping.categorical_map(_umlauts(df), "segment", _spelled))),
     f"SELECT record_id, CASE WHEN regexp_matches(n, '[^\\x00-\\x7F]') THEN upper(replace(replace(trim(n), 'Ü', 'UE'), 'ü', 'ue')) ELSE {_TITLE.format('lower(trim(n))')} END AS segment FROM (SELECT record_id, CASE WHEN record_id % 2 = 0 THEN translate(segment, 'Uu', 'Üü') ELSE segment END AS n FROM people)", "people")
_add("standardize_case_typos", _on("sales", lambda df: mapping.standardize_case(df.select("o_orderkey", "urgency"), "urgency")), "SELECT o_orderkey, CASE WHEN urgency IN ('urgnt', 'Urgent ') THEN 'Urgent' ELSE 'High' END AS urgency FROM sales", "sales")
_add("name_clusters", _on("people", lambda df: mapping.name_clusters(df, "full_name")), core_sql.name_clusters(), "people")
_pairs = lambda df: df.where("full_name IS NOT NULL").select("record_id", F.lower(F.trim("full_name")).alias("a"), F.reverse(F.lower(F.trim("full_name"))).alias("b"))
_lcs = """list_reduce(list_concat([list_transform(string_split(b, ''), lambda x: 0)], list_transform(string_split(a, ''), lambda c: list_transform(string_split(b, ''), lambda d: CASE WHEN c = d THEN 1 ELSE 0 END))),
  lambda row, hit: list_reduce(list_concat([[0, 0]], list_transform(range(1, len(hit) + 1), lambda j: [hit[j], row[j], CASE WHEN j > 1 THEN row[j - 1] ELSE 0 END])), lambda acc, h: list_append(acc, CASE WHEN h[1] = 1 THEN h[3] + 1 ELSE greatest(h[2], acc[len(acc)]) END))[3:])"""
_add("fuzz_ratio_pairs", _on("people", lambda df: _pairs(df).select("record_id", F.round(fuzzy.ratio_udf("a", "b"), 6).alias("similarity"))),
     f"WITH p AS (SELECT DISTINCT lower(trim(full_name)) AS a, reverse(lower(trim(full_name))) AS b FROM people WHERE full_name IS NOT NULL), s AS (SELECT a, round(200.0 * list_last({_lcs}) / (length(a) + length(b)), 6) AS similarity FROM p) SELECT record_id, similarity FROM people JOIN s ON lower(trim(full_name)) = a", "people")
_add("fuzz_ratio_expression", _on("people", lambda df: df.where("full_name IS NOT NULL").select(F.lower(F.trim("full_name")).alias("a")).distinct().select("a", F.reverse("a").alias("b")).select("a", F.round(fuzzy.ratio_expr(F.col("a"), F.col("b")), 6).alias("similarity"))),
     f"WITH p AS (SELECT DISTINCT lower(trim(full_name)) AS a, reverse(lower(trim(full_name))) AS b FROM people WHERE full_name IS NOT NULL) SELECT a, round(200.0 * list_last({_lcs}) / (length(a) + length(b)), 6) AS similarity FROM p", "people")
_add("token_sort_pairs", _on("people", lambda df: _pairs(df).select("record_id", F.round(fuzzy.token_sort_udf("a", F.concat(F.element_at(F.split("a", " "), -1), F.lit(" "), F.col("a"))), 6).alias("similarity"))),
     f"WITH w AS (SELECT DISTINCT lower(trim(full_name)) AS n, list_filter(string_split(lower(trim(full_name)), ' '), lambda x: x <> '') AS x FROM people WHERE full_name IS NOT NULL), p AS (SELECT n, array_to_string(list_sort(x), ' ') AS a, array_to_string(list_sort(list_append(x, x[len(x)])), ' ') AS b FROM w), s AS (SELECT n, round(200.0 * list_last({_lcs}) / (length(a) + length(b)), 6) AS similarity FROM p) SELECT record_id, similarity FROM people JOIN s ON lower(trim(full_name)) = n", "people")
_base = lambda df: numbered(df, ["record_id"])
_keyed = f"(SELECT record_id, {_KEY.format('full_name')} AS k, row_number() OVER (ORDER BY record_id) - 1 AS rid FROM people)"
_add("sorted_neighbourhood_pairs", _on("people", lambda df: dedup.sorted_neighbourhood(_base(df), "full_name", 11)),
     f"""WITH k AS (SELECT k, rid, min(rid) OVER (PARTITION BY k) AS f FROM {_keyed} WHERE k <> ''), r AS (SELECT k, min(f) AS f, row_number() OVER (ORDER BY k) AS i FROM k GROUP BY k),
    p AS (SELECT a.f AS x, b.f AS y FROM r a JOIN r b ON b.i > a.i AND b.i <= a.i + 5 UNION SELECT f, rid FROM k WHERE rid <> f) SELECT DISTINCT least(x, y) AS rid_a, greatest(x, y) AS rid_b FROM p""", "people")  # fmt: skip
_add("full_pairs_small", lambda s, d: dedup.full_pairs(numbered(frame(s, d, "nation"), ["n_nationkey"]), "n_name"), "SELECT a.n_nationkey::BIGINT AS rid_a, b.n_nationkey::BIGINT AS rid_b FROM nation a JOIN nation b ON a.n_nationkey < b.n_nationkey")
_filled = _nn(_people)
_add("dedup_gov_id", _on("people", lambda df: dedup.star_pairs(_base(df), ["pan"])),
     f"WITH k AS (SELECT row_number() OVER (ORDER BY record_id) - 1 AS rid, {_KEY.format('pan')} AS k, {_filled} AS c FROM people), f AS (SELECT *, first_value(rid) OVER (PARTITION BY k ORDER BY c DESC, rid) AS a FROM k WHERE k <> '') SELECT a AS rid_a, rid AS rid_b FROM f WHERE rid <> a", "people")
_tiers = lambda df: classify.tiers(df.columns)
_next_rows = lambda df: _base(df).where("_rid > 0").select((F.col("_rid") - 1).alias("rid_a"), F.col("_rid").alias("rid_b"))
_facts_sql, _next_sql = core_sql.facts(_KEY, _phone), core_sql.judged(core_sql.NEXT)
_judged = lambda df: dedup.Engine(_tiers(df)).judged(dedup.Engine(_tiers(df)).facts(_base(df)), _next_rows(df))
# each row with the next: copies of a customer, and strangers
_add("dedup_rules_decision", _on("people", lambda df: _judged(df).groupBy("decision", "link", "reason").agg(F.count("*").alias("n"))), f"WITH RECURSIVE {_facts_sql}, {_next_sql} SELECT decision, link, reason, count(*) AS n FROM j GROUP BY 1, 2, 3", "people")
_add("dedup_pair_rules", _on("people", lambda df: _rounded(_judged(df), ["similarity"])), f"WITH RECURSIVE {_facts_sql}, {_next_sql} SELECT rid_a, rid_b, round(similarity, 6) AS similarity, decision, link, reason FROM j", "people")
_add("name_similarity_pairs", _on("people", lambda df: _pairs(df).select("a", F.concat(F.element_at(F.split("a", " "), -1), F.lit(" "), F.substring("a", 1, 9)).alias("b")).distinct().select("a", "b", F.round(fuzzy.name_udf("a", "b"), 6).alias("similarity"), F.round(fuzzy.token_set_udf("a", "b"), 6).alias("token_set"), F.round(fuzzy.partial_udf("a", "b"), 6).alias("partial"))),
     f"""WITH need AS MATERIALIZED (SELECT DISTINCT a AS na, list_last(string_split(a, ' ')) || ' ' || substr(a, 1, 9) AS nb FROM (SELECT lower(trim(full_name)) AS a FROM people WHERE full_name IS NOT NULL)), {core_sql.similarities('need')}
    SELECT s.na AS a, s.nb AS b, round(s.similarity, 6) AS similarity, round(CASE WHEN s.na = s.nb OR com <> '' AND (oa = '' OR ob = '') THEN 100 WHEN com <> '' THEN greatest(b.r, c.r, d.r) ELSE b.r END, 6) AS token_set, round(coalesce(part.r, 100), 6) AS partial
    FROM sim s LEFT JOIN t ON t.na = s.na AND t.nb = s.nb LEFT JOIN part ON part.na = s.na AND part.nb = s.nb LEFT JOIN ratios b ON b.x = fa AND b.y = fb LEFT JOIN ratios c ON c.x = com AND c.y = fa LEFT JOIN ratios d ON d.x = com AND d.y = fb""", "people")  # fmt: skip
_tree = lambda s, d: frame(s, d, "orders").select(F.col("o_orderkey").alias("a"), (F.col("o_orderkey") - F.col("o_orderkey") % 4).alias("b"))
_add("connected_components", lambda s, d: graph.components(_tree(s, d)),
     "SELECT DISTINCT node, min(node) OVER (PARTITION BY g) AS label FROM (SELECT o_orderkey AS node, o_orderkey - o_orderkey % 4 AS g FROM orders UNION SELECT o_orderkey - o_orderkey % 4, o_orderkey - o_orderkey % 4 FROM orders WHERE o_orderkey % 4 <> 0) QUALIFY count(*) OVER (PARTITION BY g) > 1")
_clustered = lambda df: _base(df).withColumn("_cid", F.col("_rid") - F.col("_rid") % 2)
_c = f"c AS (SELECT *, row_number() OVER (ORDER BY record_id) - 1 AS rid, CAST((row_number() OVER (ORDER BY record_id) - 1) // 2 * 2 AS BIGINT) AS cid, {' + '.join(f'CASE WHEN {x} IS NULL THEN 1 ELSE 0 END' for x in _people)} AS gaps FROM people)"


def _gold(c: str) -> str:
    ok = f"{_KEY.format(c)} <> ''"
    return f"coalesce((arg_min(struct_pack(v := CASE WHEN {ok} THEN {c} END), struct_pack(g := gaps, r := rid))).v, arg_min({c}, rid) FILTER ({ok})) AS {c}"


_joined = lambda c, n: f"(SELECT string_agg(x, ', ' ORDER BY r) FROM (SELECT arg_min({c}, rid) AS x, min(rid) AS r FROM c i WHERE i.cid = o.cid AND {n} <> '' GROUP BY {n})) AS {c}"
_add("golden_record", _on("people", lambda df: dedup.golden_records(_clustered(df.select("record_id", "full_name", "email", "phone", "city", "pan", "age", "salary", "segment", "active", "mostly_empty")), _tiers(df)).select(F.col("_cid").alias("cid"), "full_name", "email", "phone", "city", "pan", F.col("age").cast("double").alias("age"), "cluster_size")),
     f"""WITH {_c}, g AS (SELECT cid, {', '.join(map(_gold, ('full_name', 'city', 'pan')))}, median(age)::DOUBLE AS age, count(*) AS cluster_size FROM c GROUP BY cid),
    e AS (SELECT cid, string_agg(x, ', ' ORDER BY r) AS email FROM (SELECT cid, arg_min(email, rid) AS x, min(rid) AS r FROM c WHERE {_KEY.format('email')} <> '' GROUP BY cid, {_KEY.format('email')}) GROUP BY cid),
    p AS (SELECT cid, string_agg(x, ', ' ORDER BY r) AS phone FROM (SELECT cid, arg_min(phone, rid) AS x, min(rid) AS r FROM c WHERE length({_phone}) >= 7 GROUP BY cid, {_phone}) GROUP BY cid)
    SELECT g.cid, full_name, email, phone, city, pan, age, cluster_size FROM g LEFT JOIN e ON g.cid = e.cid LEFT JOIN p ON g.cid = p.cid""", "people")  # fmt: skip
_add("cluster_backfill", _on("people", lambda df: dedup.backfill(_clustered(df.select("record_id", "full_name", "phone", "email")), ["full_name", "phone", "email"]).drop("_rid", "_cid")),
     f"WITH {_c} SELECT record_id, " + ", ".join(f"CASE WHEN {_KEY.format(x)} <> '' THEN {x} ELSE coalesce(arg_min({x}, rid) FILTER ({_KEY.format(x)} <> '') OVER (PARTITION BY cid), {x}) END AS {x}" for x in ("full_name", "phone", "email")) + " FROM c", "people")
_add("merge_totals", _on("people", lambda df: audit.merge_totals(dedup.cluster_report(_clustered(df)))), f"WITH {_c} SELECT count(*) AS clusters, coalesce(sum(n - 1), 0)::BIGINT AS merged_rows FROM (SELECT count(*) AS n FROM c GROUP BY cid HAVING count(*) > 1)", "people")
_key = lambda c: f"coalesce({_KEY.format(c)}, '')"
_add("dedup_changes", _on("people", lambda df: dedup.changes(_clustered(df), _tiers(df))),
     f"""WITH {_c}, n AS (SELECT cid, full_name, rid, gaps_name AS gaps FROM (SELECT *, CASE WHEN full_name IS NULL THEN 1 ELSE 0 END AS gaps_name FROM c)),
    g AS (SELECT cid, {_gold('full_name')}, count(*) AS k FROM n GROUP BY cid HAVING count(*) > 1), r AS (SELECT n.cid, n.rid, n.full_name, g.full_name AS corrected, k FROM n JOIN g ON n.cid = g.cid)
    SELECT cid AS cluster, coalesce(arg_min(full_name, rid) FILTER ({_key('full_name')} <> {_key('corrected')}), arg_min(full_name, rid)) AS original, corrected, k AS cluster_size, count(DISTINCT full_name) AS variants FROM r GROUP BY cid, corrected, k""", "people")  # fmt: skip
_differ = lambda c: f"({_key('a.' + c)} <> '' AND {_key('b.' + c)} <> '' AND {_key('a.' + c)} <> {_key('b.' + c)})"
_add("conflicting_identifiers", _on("people", lambda df: dedup.conflicts(_base(df), _base(df).where("_rid % 2 = 0").select(F.col("_rid").alias("rid_a"), (F.col("_rid") + 1).alias("rid_b")), ["pan", "email"])),
     f"WITH {_c} SELECT a.rid AS rid_a, b.rid AS rid_b, {_differ('pan')} OR {_differ('email')} AS conflict FROM c a JOIN c b ON a.rid % 2 = 0 AND b.rid = a.rid + 1", "people")
_rest = ["city", "pan", "segment", "active", "mostly_empty"]
_add("enrich_all_rows", _on("people", lambda df: dedup.enrich(_clustered(df), _tiers(df)).drop("_rid", "_cid")),
     f"""WITH {_c}, g AS (SELECT cid, {', '.join(map(_gold, ['full_name', *_rest]))}, count(*) AS k FROM c GROUP BY cid),
    e AS (SELECT cid, string_agg(x, ', ' ORDER BY r) AS email FROM (SELECT cid, arg_min(email, rid) AS x, min(rid) AS r FROM c WHERE {_KEY.format('email')} <> '' GROUP BY cid, {_KEY.format('email')}) GROUP BY cid),
    p AS (SELECT cid, string_agg(x, ', ' ORDER BY r) AS phone FROM (SELECT cid, arg_min(phone, rid) AS x, min(rid) AS r FROM c WHERE length({_phone}) >= 7 GROUP BY cid, {_phone}) GROUP BY cid),
    a AS (SELECT g.cid, {', '.join(f'CASE WHEN k > 1 THEN g.{x} END AS g_{x}' for x in ['full_name', *_rest])}, CASE WHEN k > 1 THEN e.email END AS g_email, CASE WHEN k > 1 THEN p.phone END AS g_phone FROM g LEFT JOIN e ON g.cid = e.cid LEFT JOIN p ON g.cid = p.cid)
    SELECT record_id, coalesce(g_full_name, full_name) AS full_name, {', '.join(f"CASE WHEN {_KEY.format(x)} <> '' THEN {x} ELSE coalesce(g_{x}, {x}) END AS {x}" for x in ['email', 'phone', *_rest])}, age, salary FROM c JOIN a ON c.cid = a.cid""", "people")  # fmt: skip
_add("health_clusters_type12", _on("people", lambda df: dedup.health_clusters(_clustered(df), _tiers(df)).groupBy("kind").agg(F.count("*").alias("n"))),
     "WITH " + _c + ", k AS (SELECT cid, count(DISTINCT (" + ", ".join(f"coalesce({_PROFILE.format(x)}, '')" for x in _dup_cols) + f")) = 1 AS e, count(DISTINCT nullif({_KEY.format('email')}, '')) > 1 OR count(DISTINCT nullif({_KEY.format('phone')}, '')) > 1 AS d, count(*) AS n FROM c GROUP BY cid) SELECT CASE WHEN e THEN 'exact' WHEN d THEN 'contacts differ' ELSE 'contacts agree' END AS kind, count(*) AS n FROM k WHERE n > 1 GROUP BY 1", "people")
_add("low_quality_rows", _on("people", lambda df: dedup.low_quality(df, classify.Tiers(gov=("pan",), phone=("phone",))).select("record_id")), f"SELECT record_id FROM people WHERE {_KEY.format('pan')} = '' AND {_KEY.format('phone')} = ''", "people")
_core = f"WITH RECURSIVE {_facts_sql}, {core_sql.judged(core_sql.SHARED)}, {core_sql.clusters(_people)}"
_engine_clusters = lambda df: dedup.Engine(_tiers(df)).clusters(_base(df))
_add("people_clusters", _on("people", lambda df: _engine_clusters(df).select("record_id", "_cid")), f"{_core} SELECT record_id, cid AS _cid FROM c", "people")
_first_known = lambda c: f"coalesce((arg_min(struct_pack(v := {c}), struct_pack(g := gaps, r := rid))).v, arg_min({c}, rid) FILTER ({c} IS NOT NULL)) AS {c}"
_contacts = f"""e AS (SELECT cid, string_agg(x, ', ' ORDER BY r) AS email FROM (SELECT cid, arg_min(email, rid) AS x, min(rid) AS r FROM c WHERE {_KEY.format('email')} <> '' GROUP BY cid, {_KEY.format('email')}) GROUP BY cid),
    h AS (SELECT cid, string_agg(x, ', ' ORDER BY r) AS phone FROM (SELECT cid, arg_min(phone, rid) AS x, min(rid) AS r FROM c WHERE length({_phone}) >= 7 GROUP BY cid, {_phone}) GROUP BY cid)"""
_add("deduplicate_people", _on("people", lambda df: _rounded(dedup.deduplicate(df, ["record_id"])[0], ["age"])),
     f"""{_core}, g AS (SELECT cid, {', '.join(map(_gold, ['full_name', *_rest]))}, {_first_known('record_id')}, {_first_known('salary')}, round(median(age), 6)::DOUBLE AS age FROM c GROUP BY cid), {_contacts}
    SELECT record_id, full_name, email, phone, {', '.join(_rest)}, age, salary FROM g LEFT JOIN e ON g.cid = e.cid LEFT JOIN h ON g.cid = h.cid""", "people")  # fmt: skip
_add("cluster_report", _on("people", lambda df: dedup.deduplicate(df, ["record_id"])[1]), f"{_core} SELECT cid AS cluster, count(*) AS cluster_size, arg_min(full_name, rid) FILTER ({_KEY.format('full_name')} <> '') AS canonical_name, min(rid) AS first_row, max(rid) AS last_row FROM c GROUP BY cid HAVING count(*) > 1", "people")
_add("replayed_clusters", _on("people", lambda df: replay.replayed(_base(df), dedup.Engine(_tiers(df))).select("record_id", "_cid")))
_add("cluster_rows", _on("people", lambda df: dedup.cluster_rows(_engine_clusters(df))), f"{_core} SELECT cid AS cluster, row_number() OVER (PARTITION BY cid ORDER BY rid) AS place, rid AS row_number FROM c QUALIFY count(*) OVER (PARTITION BY cid) > 1", "people")
_add("enrich_people", _on("people", lambda df: dedup.enrich(_engine_clusters(df), _tiers(df)).drop("_rid", "_cid")),
     f"""{_core}, g AS (SELECT cid, {', '.join(map(_gold, ['full_name', *_rest]))}, count(*) AS k FROM c GROUP BY cid), {_contacts},
    a AS (SELECT g.cid, {', '.join(f'CASE WHEN k > 1 THEN g.{x} END AS g_{x}' for x in ['full_name', *_rest])}, CASE WHEN k > 1 THEN e.email END AS g_email, CASE WHEN k > 1 THEN h.phone END AS g_phone FROM g LEFT JOIN e ON g.cid = e.cid LEFT JOIN h ON g.cid = h.cid)
    SELECT record_id, coalesce(g_full_name, full_name) AS full_name, {', '.join(f"CASE WHEN {_KEY.format(x)} <> '' THEN {x} ELSE coalesce(g_{x}, {x}) END AS {x}" for x in ['email', 'phone', *_rest])}, age, salary FROM c JOIN a ON c.cid = a.cid""", "people")  # fmt: skip
_add("people_changes", _on("people", lambda df: dedup.changes(_engine_clusters(df), _tiers(df))),
     f"""{_core}, n2 AS (SELECT cid, full_name, rid, CASE WHEN full_name IS NULL THEN 1 ELSE 0 END AS gaps FROM c),
    g AS (SELECT cid, {_gold('full_name')}, count(*) AS k FROM n2 GROUP BY cid HAVING count(*) > 1), r AS (SELECT n2.cid, n2.rid, n2.full_name, g.full_name AS corrected, k FROM n2 JOIN g ON n2.cid = g.cid)
    SELECT cid AS cluster, coalesce(arg_min(full_name, rid) FILTER ({_key('full_name')} <> {_key('corrected')}), arg_min(full_name, rid)) AS original, corrected, k AS cluster_size, count(DISTINCT full_name) AS variants FROM r GROUP BY cid, corrected, k""", "people")  # fmt: skip

# ---- console, run ---------------------------------------------------------------------------------------------------


def _action(name: str) -> Query:
    def run(s: SparkSession, d: str) -> DataFrame:
        df = frame(s, d, "orders")
        df.createOrReplaceTempView("orders_view")
        return console.Console(s).run(console.quick_actions("orders_view", df.columns, "o_orderkey")[name])

    return run


_order_cols = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"]
_add("nl_duplicates", _action("duplicates"), "SELECT o_orderkey, o_custkey, o_orderstatus, count(*) AS duplicate_count FROM orders GROUP BY 1, 2, 3 HAVING count(*) > 1")
_add("nl_null_counts", _action("nulls"), " UNION ALL ".join(f"SELECT '{c}' AS column_name, count(*) AS null_count FROM orders WHERE {c} IS NULL" for c in _order_cols))
_add("nl_summary", _action("summary"), "SELECT count(*) AS total_rows, count(DISTINCT o_orderkey) AS unique_count FROM orders")
_add("nl_top10", _action("top10"), "SELECT * FROM orders ORDER BY o_orderkey LIMIT 10")
_add("nl_count", _action("count"), "SELECT count(*) AS row_count FROM orders")


def _cleaned(s: SparkSession, d: str) -> pipeline.Result:
    return pipeline.clean(frame(s, d, "people").drop("mostly_empty"), ["record_id"])


_add("clean_people", lambda s, d: _cleaned(s, d).table)
_add("audit_trail", lambda s, d: _cleaned(s, d).audit)

__all__ = ["oracle_sql", "queries"]
