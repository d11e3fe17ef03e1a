"""Plain relational queries: one statement that both Spark SQL and an ANSI engine run.

@name is a table; a few functions differ by name and are written sha(x), text(x), strip(x), tokens(x) and stamp(x).
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from papyrine.sources.tables import table

_SPARK = {
    "sha": r"sha2({0}, 256)",
    "text": r"CAST({0} AS STRING)",
    "strip": r"btrim(regexp_replace({0}, '\\s+', ' '))",
    "tokens": r"regexp_extract_all(lower({0}), '[a-z0-9]+', 0)",
    "stamp": r"date_format({0}, 'yyyyMMddHHmm')",
    "iso": r"date_format(date_trunc('second', {0}), 'yyyy-MM-dd\'T\'HH:mm:ss\'Z\'')",
}
_ANSI = {
    "sha": "sha256({0})",
    "text": "CAST({0} AS VARCHAR)",
    "strip": r"trim(regexp_replace({0}, '\s+', ' ', 'g'))",
    "tokens": "regexp_extract_all(lower({0}), '[a-z0-9]+')",
    "stamp": "strftime({0}, '%Y%m%d%H%M')",
    "iso": "strftime({0}, '%Y-%m-%dT%H:%M:%SZ')",
}


def _filled(sql: str, forms: dict[str, str]) -> str:
    pattern = re.compile(rf"#({'|'.join(forms)})\(([^#]*?)\)#")
    while pattern.search(sql):
        sql = pattern.sub(lambda m: forms[m[1]].format(m[2]), sql)
    return sql


def ansi(sql: str) -> str:
    return re.sub(r"@(\w+)", r"\1", _filled(sql, _ANSI))


def spark_query(sql: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        filled = _filled(sql, _SPARK)
        tables = set(re.findall(r"@(\w+)", filled))
        return spark.sql(re.sub(r"@(\w+)", r"{\1}", filled), **{t: table(spark, sf_dir, t) for t in tables})

    return run
