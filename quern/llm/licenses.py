"""License notices in documents, with DataFrame functions only.

Base phrases are found wherever their words stand next to each other. Notices are found by an exact
set-similarity join of text blocks with templates. A template's blocks are all runs of twice as many
words as it has different ones, whatever lines they are on. Tokens are in the order of their frequency
in the corpus, rarest first; a template is indexed by its prefix, so short that a block which holds
enough of the template must share one of its tokens; length and positional filters drop pairs that
can't reach the threshold; the rest are verified on whole token sets. Texts are read once: what the
join needs of them is written as a narrow table.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.sources.shared import written

#: Base phrases and their labels.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: Notices by label.
TEMPLATES = {
    "apache": "Licensed under the Apache License, Version 2.0.",
    "bsd": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "cc-by-nc": "Licensed under CC BY-NC 4.0.",
    "gpl": "This work is licensed under the GNU General Public License, version 3.",
    "mit": "Released under the MIT License.",
    "mit-permission": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
    "mpl": "This Source Code Form is subject to the terms of the Mozilla Public License",
    "public-domain": "This work is dedicated to the public domain.",
    "reserved": "All rights reserved.",
}
#: Percent of a template's tokens that a block must hold.
THRESHOLD = 80
#: Words of a block, as a multiple of the template's different ones.
REACH = 2
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """Words of a text in order, A-Z lower-cased; null has none."""
    lowered = F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)
    return F.filter(F.split(lowered, BREAK), lambda w: w != "")


def template_tokens() -> dict[str, list[str]]:
    """Distinct words of each template."""
    import re

    split = lambda t: dict.fromkeys(w for w in re.split(BREAK, t.lower()) if w)
    return {label: list(split(text)) for label, text in TEMPLATES.items()}


def needed(size: int) -> int:
    """Tokens that a block must share with a template of so many."""
    return math.ceil(size * THRESHOLD / 100)


def _once(df: DataFrame, name: str, column: Column) -> DataFrame:
    return df.select("*", F.explode(F.array(column)).alias(name))


def vocabulary() -> list[str]:
    return sorted({t for tokens in template_tokens().values() for t in tokens})


def widest() -> int:
    """Words of the longest block."""
    return REACH * max(map(len, template_tokens().values()))


def token_order(present: DataFrame) -> list[str]:
    """The templates' tokens, those in the fewest documents first; ties by the token. ``present`` holds
    each document's tokens in an array of that name. The result has as many entries as the templates have words."""
    found = present.select(F.explode("present").alias("token")).groupBy("token").agg(F.count("*").alias("n"))
    counts = {r["token"]: r["n"] for r in found.collect()}
    return sorted(vocabulary(), key=lambda t: (counts.get(t, 0), t))


def blocks_of(w: Column, present: Column) -> Column:
    """array<array<string>>: the blocks of a document's words that start at a token of a template, as
    long as the longest; words that no template has are null. A block that starts elsewhere holds no
    more than one of these. Documents without enough of any template have none."""
    tokens, last = F.lit(vocabulary()), widest()
    enough = F.lit(False)
    for own in template_tokens().values():
        enough = enough | (F.size(F.array_intersect(present, F.lit(own))) >= needed(len(own)))
    starts = F.filter(F.transform(w, lambda x, i: F.when(F.array_contains(tokens, x), i + 1)), lambda i: i.isNotNull())
    block = lambda i: F.transform(F.slice(w, i, last), lambda x: F.when(F.array_contains(tokens, x), x))
    return F.when(enough, F.transform(starts, block)).otherwise(F.array().cast("array<array<string>>"))


def template_index(spark, order: list[str]) -> DataFrame:
    """(token, at, size, need, label, tokens): the prefix of each template in frequency order."""
    place = {t: k for k, t in enumerate(order)}
    rows = []
    for label, tokens in template_tokens().items():
        ranked = sorted(tokens, key=place.__getitem__)
        need = needed(len(ranked))
        for at, token in enumerate(ranked[: len(ranked) - need + 1]):
            rows.append(F.struct(F.lit(token).alias("token"), F.lit(at).alias("at"), F.lit(len(ranked)).alias("size"), F.lit(need).alias("need"), F.lit(label).alias("label"), F.lit(ranked).alias("tokens")))
    return spark.range(1).select(F.inline(F.array(*rows)))


def notices(held: DataFrame) -> DataFrame:
    """(row, found array<label>, held) from (row, present, blocks): labels of templates of which some
    block of a row holds the threshold, and the largest share held."""
    order = token_order(held)
    index = template_index(held.sparkSession, order)
    blocks = held.select("row", F.explode("blocks").alias("s")).select("row", "s", F.array_intersect(F.lit(order), "s").alias("b"))
    probes = blocks.select("row", "s", F.size("b").alias("nb"), F.posexplode("b").alias("p", "token"))
    length = F.col("nb") >= F.col("need")
    prefix = F.col("p") <= F.col("nb") - F.col("need")
    position = F.least(F.col("nb") - F.col("p"), F.col("size") - F.col("at")) >= F.col("need")
    candidates = probes.join(F.broadcast(index), "token").where(length & prefix & position)  # the templates are a fixed list
    common = F.size(F.array_intersect(F.slice("s", F.lit(1), F.col("size") * REACH), "tokens"))
    told = candidates.select("row", "label", "size", "need", common.alias("common")).where("common >= need")
    return told.groupBy("row").agg(F.collect_set("label").alias("found"), F.max(F.col("common") / F.col("size")).alias("held"))


def _hits(w: Column) -> Column:
    """(label, at) of every place of a base phrase. Texts without a first word are passed by."""

    def label(x: Column, i: Column) -> Column:
        out = F.lit(None).cast("string")
        for phrase, name in PHRASES.items():
            first, *rest = phrase.split(" ")
            fits = x == first
            for k, other in enumerate(rest):
                fits = fits & (F.get(w, i + k + 1) == other)
            out = F.when(fits, F.lit(name)).otherwise(out)
        return F.struct(out.alias("label"), i.alias("at"))

    told = F.filter(F.transform(w, label), lambda h: h["label"].isNotNull())
    rarest = F.arrays_overlap(w, F.lit(sorted({p.split(" ")[-1] for p in PHRASES})))
    return F.when(rarest, told).otherwise(F.array().cast("array<struct<label: string, at: int>>"))


def scan(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score) for every row.

    Base phrases count at all their places. ``labels`` adds those of templates of which a block holds
    the threshold. The score is 1 with a base phrase, else the largest share of a template held in a
    block, from the threshold up, else 0. A null text is empty: no words, no labels. Rows are judged
    one by one, whatever doc_ids they share. Other columns are ignored.
    """
    split = _once(docs.select("doc_id", "text"), "w", words(F.col("text"))).select("doc_id", "w")
    hits = _once(_once(split, "h", _hits(F.col("w"))), "present", F.array_intersect(F.lit(vocabulary()), "w"))
    told = hits.select(
        "doc_id", F.size("w").cast("long").alias("n_words"), F.size("h").cast("long").alias("n_base"), F.array_min("h.at").cast("long").alias("first_word"), F.array_max("h.at").cast("long").alias("last_word"),
        F.array_sort(F.array_distinct("h.label")).alias("named"), "present", blocks_of(F.col("w"), F.col("present")).alias("blocks"), F.monotonically_increasing_id().alias("row"),
    )
    rows = written(told, "words")
    both = rows.drop("present", "blocks").join(notices(rows), "row", "left")
    every = F.array_sort(F.array_union("named", F.coalesce("found", F.array().cast("array<string>"))))
    score = F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce("held", F.lit(0.0)))
    return both.select("doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join("named", ",").alias("base_labels"), F.array_join(every, ",").alias("labels"), score.cast("double").alias("score"))


def _sql() -> str:
    """The same in DuckDB: every block against every template, without filters but that the whole text
    must hold enough."""
    listed = lambda xs: "[" + ", ".join(f"'{x}'" for x in xs) + "]"
    rows = ", ".join(f"('{label}', {listed(tokens)}, {needed(len(tokens))})" for label, tokens in template_tokens().items())
    lowered = f"translate(coalesce(text, ''), '{UPPER}', '{LOWER}')"
    split = "list_filter(regexp_split_to_array({}, '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x != '')"
    cases = " ".join("when " + " and ".join(f"w[i + {k}] = '{x}'" for k, x in enumerate(p.split(" "))) + f" then '{name}'" for p, name in PHRASES.items())
    return f"""with t(label, tokens, need) as (values {rows}),
d as (select doc_id, {split.format(lowered)} w from documents),
h as (select doc_id, label, i from (select doc_id, case {cases} end label, i from (select doc_id, w, unnest(range(1, len(w) + 1)) i from d)) where label is not null),
b as (select doc_id, count(*) n, min(i) - 1 lo, max(i) - 1 hi, list_sort(list_distinct(list(label))) ls from h group by 1),
l as (select doc_id, w, label, tokens, need from d, t where len(list_intersect(tokens, w)) >= need),
k as (select doc_id, label, tokens, need, unnest(list_transform(range(1, len(w) + 1), lambda i: len(list_intersect(tokens, w[i:i + {REACH} * len(tokens) - 1])))) common from l),
m as (select doc_id, label, common / len(tokens) share from k where common >= need),
f as (select doc_id, list(distinct label) ls, max(share) share from m group by 1)
select d.doc_id, len(w)::bigint n_words, coalesce(n, 0)::bigint n_base, lo::bigint first_word, hi::bigint last_word, coalesce(array_to_string(b.ls, ','), '') base_labels,
coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(b.ls, []), coalesce(f.ls, [])))), ','), '') labels,
case when n > 0 then 1.0 else coalesce(share, 0) end::double score from d left join b using (doc_id) left join f using (doc_id)"""


SQL = _sql()
