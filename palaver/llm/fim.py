"""Fill-in-middle: documents cut at token boundaries and put together as prefix, suffix and middle.

The Split pre-tokenizer of the tokenizers library isolates the matches of a pattern and gives their
code-point offsets; nothing is trained. The offsets of a text are one array: its length is the number
of tokens n, and the cuts are ranks in it, drawn from a hash of the document's id, so that a task that
is run again cuts alike.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palaver.llm.common import small_batches, table

# White space, a token, and the marks of prefix, suffix and middle.
SPACE = r"\x20\x09-\x0D"
TOKEN = rf"[{SPACE}]*[^{SPACE}]+|[{SPACE}]+"
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Where a token of TOKEN ends in any text: between a word and white space.
CUT = rf"(?<=[^{SPACE}])(?=[{SPACE}])"
#: Code points that are cut at once, about; a longer text goes through the pattern in parts.
BLOCK_CHARS = 2**20
#: Of 100 documents, those that are cut; of 100 that are cut, those whose suffix comes first.
CUT_PERCENT, SPM_PERCENT = 50, 80
FORM = "n long, form string, prefix_chars long, middle_chars long, output string"


@lru_cache
def splitter(pattern: str):
    from tokenizers import Regex
    from tokenizers.pre_tokenizers import Split

    return Split(Regex(pattern), behavior="isolated")


def token_ends(text: str, pattern: str = TOKEN, cut: str | None = CUT, block: int = BLOCK_CHARS) -> np.ndarray:
    """Where each token ends, in code points.

    cut matches where every text's tokens end, so a long text can be taken in parts that begin there;
    None keeps texts whole. The part behind the last cut is not searched by the pattern if it is white
    space alone, which it would try at every length.
    """
    found, begin, ends = splitter(pattern), 0, []
    where = re.compile(cut) if cut else None
    last = len(text.rstrip(" \t\n\v\f\r")) if cut == CUT else len(text)
    while begin < last:
        stop = last
        if where and begin + block < last and (m := where.search(text, begin + block, last)):
            stop = m.start()
        part = found.pre_tokenize_str(text[begin:stop])
        ends.append(begin + np.fromiter((e for _, (_, e) in part), np.int64, len(part)))
        begin = stop
    if last < len(text):
        ends.append(np.array([len(text)]))
    return np.concatenate(ends) if ends else np.empty(0, np.int64)


def draws(doc_id: Column, seed: int = 42, n: int = 4) -> list[Column]:
    """The first n groups of 8 hex digits of the sha256 of ``seed:doc_id`` as numbers."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 1 + 8 * k, 8), 16, 10).cast("long") for k in range(n)]


def fill_in_middle(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", seed: int = 42, cut_percent: int = CUT_PERCENT, spm_percent: int = SPM_PERCENT, pattern: str = TOKEN, cut: str | None = CUT) -> DataFrame:
    """docs with n, form, prefix_chars, middle_chars and output; columns of these names are replaced.

    A null text is an empty one, a null id an empty id. A text that is empty or holds a mark, or whose
    draw says so, stays as it is (plain, lengths null). Every row is judged by itself, so repeated
    rows are cut alike; an empty table gives none. Texts of any length are cut whole.
    """
    small_batches(docs.sparkSession)

    @F.pandas_udf(FORM)
    def transformed(texts: pd.Series, h1: pd.Series, h2: pd.Series, h3: pd.Series, h4: pd.Series) -> pd.DataFrame:
        rows = []
        for t, a, b, c, d in zip(texts, h1, h2, h3, h4, strict=True):
            ends = token_ends(t, pattern, cut)
            n = len(ends)
            if not t or c % 100 >= cut_percent or any(mark in t for mark in (PREFIX, SUFFIX, MIDDLE)):
                rows.append((n, "plain", None, None, t))
                continue
            first, second = (int(ends[k - 1]) if k else 0 for k in sorted((a % (n + 1), b % (n + 1))))
            prefix, middle, suffix = t[:first], t[first:second], t[second:]
            if d % 100 < spm_percent:
                rows.append((n, "spm", first, second - first, f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}"))
            else:
                rows.append((n, "psm", first, second - first, f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}"))
        out = pd.DataFrame(rows, columns=["n", "form", "prefix_chars", "middle_chars", "output"])
        return out.astype({"prefix_chars": "Int64", "middle_chars": "Int64"})

    out = docs.withColumn("__fim", transformed(F.coalesce(F.col(text), F.lit("")), *draws(F.col(doc_id), seed)))
    return out.withColumns({c: F.col(f"__fim.{c}") for c in ("n", "form", "prefix_chars", "middle_chars", "output")}).drop("__fim")


def restored(output: Column, form: Column) -> Column:
    """The text that an output of this form was made of; the marks stand in it once each."""
    part = lambda k: F.get(F.split(output, f"{PREFIX}|{SUFFIX}|{MIDDLE}"), F.lit(k))
    return F.when(form == "psm", F.concat(part(1), part(3), part(2))).when(form == "spm", F.concat(part(2), part(3), part(1))).otherwise(output)


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lengths, forms and digests of every document, its text rebuilt from the output alone."""
    rows = fill_in_middle(table(spark, sf_dir, "documents").select("doc_id", "text"))
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    return rows.select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest(F.col("output")).alias("output_sha256"), digest(restored(F.col("output"), F.col("form"))).alias("restored_sha256"))


SQL = r"""
with t as (
  select doc_id, coalesce(text, '') as text, sha256('42:' || coalesce(doc_id::varchar, '')) as h,
    regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') as parts
  from documents
), d as (
  select *, len(parts)::bigint as n,
    ('0x' || h[1:8])::bigint % (len(parts) + 1) as a, ('0x' || h[9:16])::bigint % (len(parts) + 1) as b,
    case when text = '' or contains(text, '<P>') or contains(text, '<S>') or contains(text, '<M>') or ('0x' || h[17:24])::bigint % 100 >= 50 then 'plain'
      when ('0x' || h[25:32])::bigint % 100 < 80 then 'spm' else 'psm' end as form
  from t
), s as (
  select *, coalesce(list_aggregate(parts[1:least(a, b)], 'string_agg', ''), '') as p,
    coalesce(list_aggregate(parts[least(a, b) + 1:greatest(a, b)], 'string_agg', ''), '') as m,
    coalesce(list_aggregate(parts[greatest(a, b) + 1:], 'string_agg', ''), '') as e
  from d
)
select doc_id, n, form, case when form <> 'plain' then length(p) end as prefix_chars, case when form <> 'plain' then length(m) end as middle_chars,
  sha256(case form when 'plain' then text when 'psm' then '<P>' || p || '<S>' || e || '<M>' || m else '<S>' || e || '<P>' || p || '<M>' || m end) as output_sha256,
  sha256(text) as restored_sha256
from s
"""
