"""Text functions: clean-up of generated SQL, parsing of model replies, identifiers, tokens, hashes."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

FENCE = "```"


def unfenced(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, "(?i)```(?:sql)?", ""))


def pure_sql(text: Column) -> Column:
    """From the first SELECT or WITH up to the first semicolon outside quotes, with one semicolon; text without
    either word is only trimmed."""
    plain = unfenced(text)
    found = F.regexp_extract(plain, r"(?is)\b((?:SELECT|WITH)\b(?:[^;']|'[^']*')*)", 1)
    return F.when(found == "", plain).otherwise(F.concat(F.rtrim(found), F.lit(";")))


def clean_sql(text: Column) -> Column:
    """pure_sql, cut where the first 40 characters come again, unless a set operator stands before; empty stays."""
    sql = F.regexp_replace(pure_sql(text), ";$", "")
    rest = F.substring(sql, F.lit(41), F.length(sql))
    again = F.when(F.length(sql) > 40, F.instr(rest, F.substring(sql, 1, 40))).otherwise(0)
    before = F.substring(sql, F.lit(1), 40 + again - 1)
    is_set = F.rtrim(before).rlike(r"(?i)\b(UNION|INTERSECT|EXCEPT|ALL)$")
    out = F.when((again > 0) & ~is_set, F.rtrim(before)).otherwise(sql)
    return F.when(F.trim(F.coalesce(text, F.lit(""))) == "", "").otherwise(F.concat(out, F.lit(";")))


#: The tokens that prompts must not hold.
PROMPT_TOKENS = ("[/INST]", "[INST]")


def without_tokens(value: str | None) -> str | None:
    """A text without prompt tokens, also those that form when others are removed, however deep."""
    while value is not None and "INST]" in value:
        less = value
        for token in PROMPT_TOKENS:
            less = less.replace(token, "")
        if less == value:
            break
        value = less
    return value


@F.pandas_udf(StringType())
def _sanitised(texts: pd.Series) -> pd.Series:
    return texts.map(without_tokens)


def sanitised(value: Column | str) -> Column:
    """Texts without prompt tokens; only texts that may hold one go through Python."""
    c = F.col(value) if isinstance(value, str) else value
    return F.when(F.contains(c, F.lit("INST]")), _sanitised(c)).otherwise(c)


def table_names(ddl: Column) -> Column:
    """Sorted distinct names after CREATE TABLE, without schema."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(ddl, F.lit(r"(?i)CREATE\s+TABLE\s+(?:\w+\.)?(\w+)"), F.lit(1))))


def difficulty(reply: Column) -> Column:
    """The class a reply names; NON-NESTED holds NESTED, so it is asked first. Default NON-NESTED."""
    up = F.upper(reply)
    return F.when(up.contains("NON-NESTED") | up.contains("NON_NESTED"), "NON-NESTED").when(up.contains("NESTED"), "NESTED").when(up.contains("EASY"), "EASY").otherwise("NON-NESTED")


def status(latency: Column, answer: Column, sql: Column, ex: Column, limit: float = 180.0) -> Column:
    """How an evaluated question ended; the first that holds."""
    failed = F.lower(answer).contains("desculpe") | (F.trim(F.coalesce(sql, F.lit(""))) == "")
    return F.when((latency >= limit) | answer.contains("Timed out"), "TIMEOUT_API").when(failed, "FALHA_GERACAO_SQL").when(ex == 1, "OK").otherwise("ERRO_LOGICO_SQL")


def json_list(reply: Column, schema: str) -> Column:
    """The list in a reply, fenced or not; an empty one if there is none."""
    fenced = F.regexp_extract(reply, r"(?is)```(?:json)?\s*(.*?)```", 1)
    found = F.from_json(F.when(fenced != "", fenced).otherwise(reply), f"array<{schema}>", {"mode": "PERMISSIVE"})
    return F.coalesce(F.filter(found, lambda x: x.isNotNull()), F.array().cast(f"array<{schema}>"))


def choice(reply: Column) -> Column:
    """struct<choice, reason> of a selector's free text."""
    n = F.regexp_extract(reply, r"(?i)Choice\D*(\d+)", 1)
    return F.struct(n.try_cast("int").alias("choice"), F.trim(F.regexp_extract(reply, r"(?is)Reason:\s*(.*)", 1)).alias("reason"))


def missing_name(error: Column) -> Column:
    """The column that an error says doesn't exist."""
    return F.regexp_extract(error, r"(?i)column [`\"]?(.*?)[`\"]? does not exist", 1)


@F.pandas_udf(StringType())
def normalize_identifier(names: pd.Series) -> pd.Series:
    """Names without accents and cedillas."""
    return names.str.normalize("NFKD").str.replace(r"[̀-ͯ]", "", regex=True)


def stamp(c: Column) -> Column:
    """A time as the grid shows it; null stays null."""
    return F.date_format(c, "dd/MM/yyyy HH:mm:ss")


def parsed_date(c: Column) -> Column:
    """A date written dd/mm/yyyy; what is none is null."""
    return F.try_to_timestamp(c.cast("string"), F.lit("dd/MM/yyyy")).cast("date")


def tokens(text: Column) -> Column:
    """Lower-case words of letters and digits."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda t: t != "")


def schema_hash(columns: DataFrame, pruning: bool = True) -> DataFrame:
    """(table_name, hash) over names, types, keys and comments in order, and the table's comment where there is one."""
    one = F.concat_ws(":", "column_name", "data_type", F.coalesce("comment", F.lit("None")), F.col("is_pk").cast("string"), F.col("is_fk").cast("string"))
    listed = F.transform(F.array_sort(F.collect_list(F.struct("ordinal", one.alias("c")))), lambda x: x["c"])
    about = F.coalesce(F.max("table_comment"), F.lit("no_table_comment")) if "table_comment" in columns.columns else F.lit("no_table_comment")
    head = F.concat(F.lit(f"pruning:{pruning}|"), about)
    return columns.groupBy("table_name").agg(F.sha2(F.concat_ws("|", head, F.array_join(listed, "|")), 256).alias("hash"))


def markdown(df: DataFrame, n: int = 10) -> str:
    """Up to n rows as a Markdown table, for a driver's report."""
    rows = df.limit(n).collect()
    lines = [df.columns, ["---"] * len(df.columns), *[["" if v is None else str(v) for v in r] for r in rows]]
    return "\n".join("| " + " | ".join(x) + " |" for x in lines)


#: Fixed value: what stands after rows that were left out.
NOTE = "... (resultado truncado)"


def rows_to_text(df: DataFrame, max_chars: int = 3000) -> str:
    """Rows joined by pipes, whole lines within the budget, with a note if any was left out."""
    out, used, cut = [], 0, False
    for r in df.toLocalIterator():
        line = " | ".join("" if v is None else str(v) for v in r)
        if used + len(line) + 1 > max_chars:
            cut = True
            break
        out.append(line)
        used += len(line) + 1
    return "\n".join(out + [NOTE] * cut)


def shots_of(examples: Column) -> Column:
    """An array of examples (pergunta, sql) as a prompt shows them, in a fixed form."""
    one = lambda x, i: F.concat(F.lit("Exemplo "), (i + 1).cast("string"), F.lit(":\nPergunta: "), x["pergunta"], F.lit("\n"), x["sql"])
    return F.array_join(F.transform(examples, one), "\n\n")


def classes_of(examples: Column) -> Column:
    """An array of examples (pergunta, dificuldade) as lines for a classifier, in a fixed form."""
    return F.array_join(F.transform(examples, lambda x: F.concat(F.lit("- Pergunta: '"), x["pergunta"], F.lit("' | Classificação Correta: "), x["dificuldade"])), "\n")


def _block(examples: DataFrame, n: int, block, *columns: str) -> str:
    """The first n of ordered examples as a block."""
    rows = [tuple(r[c] for c in columns) for r in examples.limit(n).collect()]
    if not rows:
        return ""
    one = examples.sparkSession.createDataFrame([(rows,)], f"l array<struct<{','.join(f'{c}:string' for c in columns)}>>")
    return one.select(block(F.col("l"))).first()[0]


def classification_block(examples: DataFrame, *order: str | Column, n: int = 3) -> str:
    """The first n examples (pergunta, dificuldade) as lines for a classifier."""
    return _block(examples.orderBy(*order), n, classes_of, "pergunta", "dificuldade")


def few_shot_block(examples: DataFrame, *order: str | Column, n: int = 4) -> str:
    """The first n examples (pergunta, sql) as a prompt shows them."""
    return _block(examples.orderBy(*order), n, shots_of, "pergunta", "sql")
