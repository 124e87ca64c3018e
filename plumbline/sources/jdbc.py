"""Databases over JDBC: connection options per engine, tables, queries, catalogue listing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

# JDBC URL, driver class and default port per engine.
ENGINES: dict[str, tuple[str, str, int | None]] = {
    "SQLite": ("jdbc:sqlite:{database}", "org.sqlite.JDBC", None),
    "PostgreSQL": ("jdbc:postgresql://{host}:{port}/{database}", "org.postgresql.Driver", 5432),
    "MySQL": ("jdbc:mysql://{host}:{port}/{database}", "com.mysql.cj.jdbc.Driver", 3306),
    "MariaDB": ("jdbc:mariadb://{host}:{port}/{database}", "org.mariadb.jdbc.Driver", 3306),
    "SQL Server": ("jdbc:sqlserver://{host}:{port};databaseName={database}", "com.microsoft.sqlserver.jdbc.SQLServerDriver", 1433),
    "Oracle": ("jdbc:oracle:thin:@//{host}:{port}/{database}", "oracle.jdbc.OracleDriver", 1521),
    "IBM Db2": ("jdbc:db2://{host}:{port}/{database}", "com.ibm.db2.jcc.DB2Driver", 50000),
    "Snowflake": ("jdbc:snowflake://{host}.snowflakecomputing.com/?db={database}", "net.snowflake.client.jdbc.SnowflakeDriver", 443),
    "BigQuery": ("jdbc:bigquery://https://www.googleapis.com/bigquery/v2:443;ProjectId={database}", "com.simba.googlebigquery.jdbc.Driver", None),
    "Redshift": ("jdbc:redshift://{host}:{port}/{database}", "com.amazon.redshift.jdbc42.Driver", 5439),
    "CockroachDB": ("jdbc:postgresql://{host}:{port}/{database}", "org.postgresql.Driver", 26257),
    "DuckDB": ("jdbc:duckdb:{database}", "org.duckdb.DuckDBDriver", None),
    "Teradata": ("jdbc:teradata://{host}/DATABASE={database},DBS_PORT={port}", "com.teradata.jdbc.TeraDriver", 1025),
    "SAP HANA": ("jdbc:sap://{host}:{port}/?databaseName={database}", "com.sap.db.jdbc.Driver", 30015),
    "Apache Hive": ("jdbc:hive2://{host}:{port}/{database}", "org.apache.hive.jdbc.HiveDriver", 10000),
    # Ships with Spark; runs inside the JVM that opens it.
    "Derby": ("jdbc:derby:{database}", "org.apache.derby.iapi.jdbc.AutoloadedDriver", None),
}


def options(engine: str, host: str = "", port: int = 0, database: str = "", user: str = "", password: str = "") -> dict[str, str]:
    """Options for ``spark.read.format('jdbc')``. Credentials stay out of the URL."""
    if engine not in ENGINES:
        raise ValueError(f"unsupported engine: {engine}")
    url, driver, default_port = ENGINES[engine]
    out = {"url": url.format(host=host, port=port or default_port, database=database), "driver": driver}
    if user:
        out["user"] = user
    if password:
        out["password"] = password
    return out


def read_table(
    spark: SparkSession, connection: dict[str, str], table: str, schema: str | None = None, max_rows: int | None = None,
    partition_column: str | None = None, bounds: tuple[int, int] | None = None, partitions: int = 1,
) -> DataFrame:
    """A table (S12). With ``partition_column`` and ``bounds`` it is read in parallel ranges.

    All rows by default; a limit, if given, is pushed into the database.
    """
    reader = spark.read.format("jdbc").options(**connection).option("dbtable", f"{schema}.{table}" if schema else table)
    if partition_column:
        reader = reader.options(
            partitionColumn=partition_column, lowerBound=str(bounds[0]), upperBound=str(bounds[1]), numPartitions=str(partitions)
        )
    df = reader.load()
    return df if max_rows is None else df.limit(max_rows)


def run_query(spark: SparkSession, connection: dict[str, str], query: str, max_rows: int | None = None) -> DataFrame:
    """The result of a query that the database runs."""
    df = spark.read.format("jdbc").options(**connection).option("query", query).load()
    return df if max_rows is None else df.limit(max_rows)


def write_table(df: DataFrame, connection: dict[str, str], table: str, mode: str = "append") -> None:
    df.write.format("jdbc").options(**connection).option("dbtable", table).mode(mode).save()


def register_catalog(spark: SparkSession, connection: dict[str, str], name: str = "db") -> str:
    """Make a database browsable as a Spark catalogue."""
    key = f"spark.sql.catalog.{name}"
    spark.conf.set(key, "org.apache.spark.sql.execution.datasources.v2.jdbc.JDBCTableCatalog")
    for k, v in connection.items():
        spark.conf.set(f"{key}.{k}", v)
    return name


def list_schemas(spark: SparkSession, catalog: str) -> DataFrame:
    """Schemas of a registered database."""
    return spark.sql(f"SHOW NAMESPACES IN {catalog}")


def list_tables(spark: SparkSession, catalog: str, schema: str) -> DataFrame:
    """Tables and views of a schema."""
    return spark.sql(f"SHOW TABLES IN {catalog}.`{schema}`").select("namespace", F.col("tableName").alias("table"))


def list_views(spark: SparkSession, connection: dict[str, str], schema: str) -> DataFrame:
    """Views of a schema, from the database's own catalogue."""
    if connection["url"].startswith("jdbc:derby:"):
        query = (
            "SELECT t.TABLENAME AS VIEW_NAME FROM SYS.SYSTABLES t JOIN SYS.SYSSCHEMAS s ON t.SCHEMAID = s.SCHEMAID "
            f"WHERE t.TABLETYPE = 'V' AND s.SCHEMANAME = '{schema}'"
        )
    else:
        query = f"SELECT table_name AS VIEW_NAME FROM information_schema.views WHERE table_schema = '{schema}'"
    return run_query(spark, connection, query, None).select(F.col("VIEW_NAME").alias("view"))


def list_columns(spark: SparkSession, connection: dict[str, str], table: str) -> DataFrame:
    """Column names and types of a table, without reading its rows."""
    fields = run_query(spark, connection, f"SELECT * FROM {table}", None).schema.fields
    rows = [(f.name, f.dataType.simpleString(), f.nullable) for f in fields]
    return spark.createDataFrame(rows, "column string, type string, nullable boolean")
