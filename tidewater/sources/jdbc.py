"""Databases over JDBC: URLs, scans, catalogue, backup and write-back. Drivers come with the cluster."""

from __future__ import annotations

import math
import time
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from ..operators.classify import infer_primary_key
from ..operators.shared import rows_frame

# URL form, driver class and port by kind of database.
DATABASES = {
    "PostgreSQL": ("jdbc:postgresql://{host}:{port}/{database}", "org.postgresql.Driver", 5432),
    "MySQL": ("jdbc:mysql://{host}:{port}/{database}", "com.mysql.cj.jdbc.Driver", 3306),
    "MariaDB": ("jdbc:mariadb://{host}:{port}/{database}", "org.mariadb.jdbc.Driver", 3306),
    "SQLite": ("jdbc:sqlite:{database}", "org.sqlite.JDBC", None),
    "SQL Server": ("jdbc:sqlserver://{host}:{port};databaseName={database};encrypt=true", "com.microsoft.sqlserver.jdbc.SQLServerDriver", 1433),
    "Oracle": ("jdbc:oracle:thin:@//{host}:{port}/{database}", "oracle.jdbc.OracleDriver", 1521),
    "DB2": ("jdbc:db2://{host}:{port}/{database}", "com.ibm.db2.jcc.DB2Driver", 50000),
    "Snowflake": ("jdbc:snowflake://{host}/?db={database}", "net.snowflake.client.jdbc.SnowflakeDriver", None),
    "Redshift": ("jdbc:redshift://{host}:{port}/{database}", "com.amazon.redshift.jdbc42.Driver", 5439),
}

# Questions to information_schema by kind of object.
METADATA = {
    "tables": "SELECT table_schema, table_name FROM information_schema.tables WHERE table_type = 'BASE TABLE'",
    "views": "SELECT table_schema, table_name, view_definition FROM information_schema.views",
    "columns": "SELECT table_schema, table_name, column_name, data_type, is_nullable FROM information_schema.columns",
    "keys": "SELECT c.table_schema, c.table_name, c.constraint_type, k.column_name FROM information_schema.table_constraints c JOIN information_schema.key_column_usage k ON c.constraint_name = k.constraint_name AND c.table_schema = k.table_schema",
    "checks": "SELECT constraint_schema, constraint_name, check_clause FROM information_schema.check_constraints",
    "triggers": "SELECT trigger_schema, trigger_name, event_object_table, event_manipulation FROM information_schema.triggers",
    "routines": "SELECT routine_schema, routine_name, routine_type FROM information_schema.routines",
}

_ERRORS = (
    (("password", "authentication", "access denied", "login failed"), "The user name or password is wrong."),
    (("refused", "could not connect", "communications link", "unreachable"), "The server can't be reached at this host and port."),
    (("timed out", "timeout"), "The server did not answer in time."),
    (("unknown database", "does not exist", "cannot open database"), "The database or table does not exist."),
    (("classnotfound", "no suitable driver"), "The JDBC driver is not on the class path."),
)


def url_for(kind: str, database: str, host: str = "localhost", port: int | None = None) -> str:
    if kind not in DATABASES:
        raise ValueError(f"unknown database {kind!r}; known are {', '.join(DATABASES)}")
    form, _, default = DATABASES[kind]
    return form.format(host=host, port=port or default, database=database)


def explain_error(message: str) -> str:
    """What a driver's message most likely means."""
    low = message.lower()
    return next((said for words, said in _ERRORS if any(w in low for w in words)), message.splitlines()[0] if message else "")


@dataclass
class Connector:
    """One database. The password is used for reads and writes and never logged or saved."""

    spark: SparkSession
    kind: str
    database: str
    host: str = "localhost"
    port: int | None = None
    user: str = ""
    password: str = field(default="", repr=False)

    @property
    def url(self) -> str:
        return url_for(self.kind, self.database, self.host, self.port)

    def options(self) -> dict[str, str]:
        out = {"url": self.url, "driver": DATABASES[self.kind][1]}
        return out | ({"user": self.user, "password": self.password} if self.user else {})

    def summary(self) -> dict[str, str]:
        return {"kind": self.kind, "host": self.host, "database": self.database, "user": self.user}

    def query(self, sql: str) -> DataFrame:
        return self.spark.read.format("jdbc").options(**self.options(), query=sql).load()

    def test(self) -> str:
        """Empty if the database answers, else what is wrong."""
        try:
            self.query("SELECT 1 AS one").first()
            return ""
        except Exception as e:
            return explain_error(str(e))

    def load_table(self, table: str, limit: int | None = None, split: str | None = None, low: int | None = None, high: int | None = None, parts: int = 64) -> DataFrame:
        """A table; split: a numeric column whose range low .. high is read in parallel parts. The range is asked of the database
        where it isn't given; an empty table is one part."""
        options = self.options() | {"dbtable": table}
        if split and (low is None or high is None):
            r = self.query(f"SELECT MIN({split}) AS low_, MAX({split}) AS high_ FROM {table}").first()
            if r[0] is None:
                split = None
            else:
                low, high = math.floor(r[0]) if low is None else low, math.ceil(r[1]) + 1 if high is None else high
        if split:
            options |= {"partitionColumn": split, "lowerBound": str(low), "upperBound": str(high), "numPartitions": str(parts)}
        df = self.spark.read.format("jdbc").options(**options).load()
        return df if limit is None else df.limit(limit)

    def metadata(self, what: str) -> DataFrame:
        return self.query(METADATA[what])

    def backup(self, table: str) -> str:
        """A copy of the whole table in the database, under a new name."""
        name = f"{table}_backup_{time.strftime('%Y%m%d_%H%M%S')}"
        self.write(self.load_table(table), name, "fail")
        return name

    def backup_csv(self, table: str, path: str) -> None:
        """The whole table as CSV files, without a row limit."""
        self.load_table(table).write.csv(path, header=True)

    def write(self, df: DataFrame, table: str, mode: str = "fail") -> None:
        """mode: replace (rows are replaced, the table's definition stays), append, fail."""
        modes = {"replace": "overwrite", "append": "append", "fail": "errorifexists"}
        writer = df.write.format("jdbc").options(**self.options(), dbtable=table, batchsize="10000")
        (writer.option("truncate", "true") if mode == "replace" else writer).mode(modes[mode]).save()


def catalog(spark: SparkSession, tables: list[str]) -> DataFrame:
    """table, column, type, is_key of registered tables and views; the key is inferred from names."""
    rows = []
    for t in tables:
        key = infer_primary_key(t, spark.table(t).columns)
        rows += [(t, c, kind, c in key) for c, kind in spark.table(t).dtypes]
    return rows_frame(spark, rows, "table string, column string, type string, is_key boolean")
