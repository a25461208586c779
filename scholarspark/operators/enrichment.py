"""Answers of a language model as rows: prompts, tries until an answer is valid, and what counts where none is.

A model is a function from a list of prompts to as many answers, called on batches in the workers. Each try is a written
table, so a row's prompts are asked once each whatever reads the result, and only rows without a valid answer are asked
again, with the next, stricter prompt.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.extract import lenient_json
from ..functions.scalar import present
from ..sources.connectors import completions
from .lineage import materialize
from .maintenance import normalise_metadata

#: What an answer's object may hold; a year is read as text, as models write it either way.
ANSWER = "title string, authors string, year string, journal_conf string, doi string, abstract string, sub_field string, open_sub_field string, proposed_method_name string"
FIELDS = [f.split()[0] for f in ANSWER.split(", ")]
#: Words that stand for no answer.
NO_ANSWER = ("null", "none")


def metadata_prompt(text: Column, sub_fields: list[str], strict: bool, examples: list[tuple[str, str]] = ()) -> Column:
    """What is asked about a paper; null for a paper without text."""
    shown = "".join(f"TEXT: {' '.join(t.split())[:400]}\nSUB_FIELD: {label or 'null'}\n" for t, label in list(examples)[:6] if t.strip())
    head = f"Give the metadata of this paper as JSON with the keys {', '.join(FIELDS)}. " + ("Answer with the JSON object and nothing else. " if strict else "") + f"Use null for what it does not say. sub_field is one of: {', '.join(sub_fields)}; if none fits, name one in open_sub_field.\n"
    return F.concat(F.lit(head + (f"Examples:\n{shown}\n" if shown else "") + "TEXT:\n"), present(text))


def ask_until_valid(rows: DataFrame, prompts: list[Column], model, parse, valid) -> DataFrame:
    """``rows`` with ``(result, tries, valid)``: the k-th prompt is asked of rows that have no valid answer before it.

    ``parse`` turns an answer into a result, null for none, ``valid`` says of a result whether it will do. Without a
    valid one the last result that was any counts. A row whose prompt is null is not asked, and has no tries.
    """
    waiting, settled = rows.withColumns({"__last": F.lit(None), "__tries": F.lit(0)}), []
    for k, prompt in enumerate(prompts):
        answered = completions(waiting.withColumn("prompt", prompt), model).withColumn("__result", parse(F.col("answer")))
        if k == 0:
            answered = answered.withColumn("__last", F.lit(None).cast(answered.schema["__result"].dataType))
        known = F.coalesce("__result", "__last")
        ok = F.coalesce(F.col("__result").isNotNull() & valid(F.col("__result")), F.lit(False))
        state = answered.select(*rows.columns, known.alias("__last"), (F.col("__tries") + F.when(F.col("prompt").isNotNull(), 1).otherwise(0)).alias("__tries"), ok.alias("__ok"))
        state = materialize(state, "answers")
        over = F.lit(k + 1 == len(prompts)) | F.col("__ok")
        settled.append(state.where(over))
        waiting = state.where(~over).drop("__ok")
    return reduce(DataFrame.unionByName, settled).withColumnsRenamed({"__last": "result", "__tries": "tries", "__ok": "valid"})


def enrich_metadata(papers: DataFrame, model, sub_fields: list[str], text_col: str = "text", retries: int = 2, examples: list[tuple[str, str]] = ()) -> DataFrame:
    """``papers`` with a model's metadata ``(title, authors, ..., year, tries, valid)`` beside their ``id``; ids are unique.

    The first prompt is plain, the ``retries`` after it are strict. An answer is JSON, or has one between its braces; it is
    valid if a value is in it and its year, if any, is one. Values are trimmed and blank ones null, fields get their
    known spelling; a paper without an answer, or without a model, has nulls.
    """
    parse = lambda a: F.when(F.length(F.regexp_replace(F.coalesce(F.to_json(lenient_json(a, ANSWER)), F.lit("")), r"[{}\s]", "")) > 0, lenient_json(a, ANSWER))
    valid = lambda r: r["year"].isNull() | (F.trim(r["year"]) == "") | F.trim(r["year"]).rlike(r"^\d+$")
    prompts = [metadata_prompt(F.col(text_col), sub_fields, k > 0, examples) for k in range(retries + 1)]
    asked = ask_until_valid(papers.select("id", text_col), prompts, model, parse, valid)
    blank = lambda c: present(F.trim(F.col(f"result.{c}"))).alias(c)
    flat = asked.select("id", *[blank(c) for c in FIELDS], "tries", "valid")
    return normalise_metadata(flat, sub_fields)


def summaries(papers: DataFrame, model, most: int = 300) -> DataFrame:
    """``(id, summary)``: a model's sentence about each paper's title and abstract, without quotes, ``most`` characters of it.

    Papers with neither are not asked; an answer that is blank, or a word for none, is null.
    """
    said = present("title").isNotNull() | present("abstract").isNotNull()
    prompt = F.when(said, F.concat(F.lit("Say in one sentence what this paper does; if it is not to be seen, answer null.\nTITLE: "), F.coalesce("title", F.lit("")), F.lit("\nABSTRACT: "), F.coalesce("abstract", F.lit(""))))
    answer = F.trim("answer")
    clean = F.when((answer != "") & ~F.lower(answer).isin(*NO_ANSWER), F.substring(F.regexp_replace(answer, r'^"+|"+$', ""), 1, most))
    return completions(papers.select("id", prompt.alias("prompt")), model).select("id", clean.alias("summary"))
