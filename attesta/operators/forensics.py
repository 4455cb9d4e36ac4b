"""Text forensics: identity leaks by line, manuscript lint rules, repository composition.

Every rule gives findings (file, line, code, severity, detail); reports are unions of rules.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attesta.functions import text as T

EMAIL = r"[A-Za-z0-9._%+\-]+@(?!example\.)[A-Za-z0-9.\-]+\.[A-Za-z]{2,}"
ORCID = r"\b\d{4}-\d{4}-\d{4}-\d{3}[\dX]\b"
HOME = r"(?:/home/|/Users/|[A-Za-z]:\\Users\\)[A-Za-z0-9._\-]+"
#: Addresses of repositories (fixed values).
REPOSITORY = r"(?i)(?:https?://|git@)?(?:www\.|raw\.|gist\.)?(?:github(?:usercontent)?\.com|gitlab\.com|bitbucket\.org|huggingface\.co)[:/][A-Za-z0-9_.-]+/[A-Za-z0-9_.-]+"
#: Addresses that hide their owner (fixed values).
NEUTRAL = ("github.com/iclr/", "github.com/acl-org/", "github.com/neurips/", "github.com/anonymous/", "gitlab.com/anonymous/", "bitbucket.org/anonymous/", "huggingface.co/anonymous/")
#: Words by which authors call a repository their own (fixed values).
OWNED = (
    r"(?i)\b(?:our\s+(?:source\s+|anonymous\s+)?(?:code|repo|repository|implementation|package|project|library|artifact|data|dataset|benchmark|model|framework|system|tool|supplement|scripts?)\b"
    r"|we\s+(?:release|provide|open[- ]source|publish|host|maintain)\b"
    r"|(?:code|implementation|repository|artifact)\s+(?:is\s+)?(?:available|released|hosted)\b"
    r"|source\s+code\s*[:=])"
)


def lines(files: DataFrame, key: str, text: str) -> DataFrame:
    """files -> key, line (from 1), body; lines without a word are left out but counted."""
    return files.select(key, F.posexplode(F.split(text, r"\r?\n")).alias("at", "body")).where(F.trim("body") != "").select(key, (F.col("at") + 1).alias("line"), "body")


def forbidden_pattern(token: str) -> str:
    """A token as a pattern; short alphanumeric ones only as whole words."""
    quoted = "".join("\\" + c if not (c.isalnum() or c == " " or ord(c) > 127) else c for c in token)
    return rf"(?i)\b{quoted}\b" if len(token) <= 4 and token.isascii() and token.isalnum() else f"(?i){quoted}"


def leaks(rows: DataFrame, key: str, tokens: tuple[str, ...] = ()) -> DataFrame:
    """rows (key, line, body) -> findings key, line, code, match: e-mail, ORCID, home path, forbidden token."""
    body = F.col("body")
    home = body.contains("/home/") | body.contains("/Users/") | body.contains(":\\Users\\")
    patterns = [("EMAIL_LEAK", EMAIL, body.contains("@")), ("ORCID_LEAK", ORCID, body.rlike(ORCID)), ("HOME_PATH_LEAK", HOME, home), *(("FORBIDDEN_TOKEN", p, body.rlike(p)) for p in map(forbidden_pattern, tokens))]
    maybe = F.lit(False)
    for *_, cheap in patterns:
        maybe = maybe | cheap

    def hits(code: str, pattern: str, cheap: Column) -> Column:
        return F.transform(F.regexp_extract_all("body", F.lit(pattern), F.lit(0)), lambda m: F.struct(F.lit(code).alias("code"), m.alias("match")))

    found = F.flatten(F.array(*[hits(*p) for p in patterns]))
    return rows.where(maybe).select(key, "line", F.explode(found).alias("f")).select(key, "line", "f.*")


def repository_urls(rows: DataFrame, key: str, tokens: tuple[str, ...] = ()) -> DataFrame:
    """rows (key, line, body) -> key, line, url, severity of every repository address of a line: error where its sentence claims it
    or it holds a forbidden token, else a warning; neutral addresses without such a token are left out.

    A sentence ends at . ! ? or ; before a blank or the end, outside addresses. Null bodies have none.
    """
    mark = "\ue000"  # stands for an address while sentences are found
    plain = F.regexp_replace("body", REPOSITORY, mark)
    found = rows.where(F.col("body").rlike(REPOSITORY)).select(key, "line", plain.alias("_plain"), F.posexplode(F.regexp_extract_all("body", F.lit(REPOSITORY), F.lit(0))).alias("_n", "_url"))
    before = F.expr(f"substring_index(_plain, '{mark}', _n + 1)")
    after = F.substring(F.col("_plain"), F.length(before) + 2, F.length("_plain"))
    sentence = F.concat(F.regexp_replace(before, r"(?s)^.*[.!?;](?=\s)", ""), F.lit(mark), F.regexp_extract(after, r"(?s)^.*?(?:[.!?;](?=\s|$)|$)", 0))
    # what only ends the sentence is no part of the address
    url = F.when(F.lower("_url").endswith(".git"), F.col("_url")).otherwise(F.regexp_replace("_url", r"[.,;:!?)>\]}]+$", ""))
    found = found.select(key, "line", url.alias("url"), sentence.alias("_sentence"))
    named = reduce(Column.__or__, [F.col("url").rlike(forbidden_pattern(t)) for t in tokens], F.lit(False))
    neutral = reduce(Column.__or__, [F.contains(F.lower("url"), F.lit(n)) for n in NEUTRAL])
    return found.where(named | ~neutral).select(key, "line", "url", F.when(named | F.col("_sentence").rlike(OWNED), "error").otherwise("warning").alias("severity"))


def redacted(match: Column) -> Column:
    return F.when(match.isNotNull(), F.lit("[REDACTED]"))


def scan_status(files: DataFrame, findings: DataFrame, key: str, complete: Column) -> DataFrame:
    """leaks_detected before incomplete before clean, a row a file."""
    n = findings.groupBy(key).agg(F.count("*").alias("n"))
    return files.join(n, key, "left").select(key, F.when(F.col("n") > 0, "leaks_detected").when(~complete, "incomplete").otherwise("clean").alias("status"), F.coalesce("n", F.lit(0)).cast("long").alias("findings"))


def composition(files: DataFrame) -> DataFrame:
    """files (path, size) -> files, bytes and estimated lines (38 bytes each) by class, with shares of bytes."""
    by = files.withColumn("class", T.path_class(F.col("path"))).groupBy("class").agg(F.count("*").alias("files"), F.sum("size").cast("long").alias("bytes"))
    total = by.where("class <> 'excluded'").agg(F.sum("bytes").alias("total"))
    out = by.crossJoin(F.broadcast(total))  # one row
    return out.select("class", "files", "bytes", F.floor(F.col("bytes") / 38).cast("long").alias("lines"), F.when(F.col("class") != "excluded", F.round(F.col("bytes") / F.col("total"), 6)).alias("share"))
