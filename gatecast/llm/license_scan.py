"""License scans with a positional index of rare words. DataFrame functions only.

Words: A-Z in lower case, runs of letters, digits and characters beyond ASCII. Base phrases are
counted wherever their words stand one after the other.

Index: every licence template is a sequence of words with the key phrases that it must contain. Its
postings are (word, template, position) for all words but the commonest ones. One pass over the texts notes
which of these words each document has; from that their document frequencies are counted over all documents,
so a word's weight is its rarity in this corpus. For each
template the rarest indexed word of its key phrases is looked up (all of these words must stand at their place, so
any one of them alone finds every start), and every (template, place where the template would start) is a candidate. A
candidate is accepted if the template's key phrases stand in the file at the relative positions of
the template; its score is the share of the template's weight that stands at its place.

Only documents that have all indexed words of some template's key phrases can hold it; their words alone
are stored and exploded to (row, position, word), of which only licence words stay. Postings and weights are as large as the list of templates, at most
``MOST_POSTINGS``, and broadcast. Words are counted per word and document before they move.

Nulls: a null text has no words. A null id is carried. Ties: labels are a sorted set, the score is the
maximum, the first and last place are a minimum and a maximum. Repeated rows are rows of their own.
Empty tables give empty results. Extra columns are not read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gatecast.llm.common import lower_ascii
from gatecast.session import materialize

# Phrase and label of the base rules.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

# Label, words of the template, key phrases that must stand at their place in it.
TEMPLATES = [
    ("apache-2.0", "licensed under the apache license version 2 0", ["apache license", "version 2 0"]),
    ("gpl-3.0", "licensed under the gnu general public license version 3", ["gnu general public license", "version 3"]),
    ("gpl-2.0", "licensed under the gnu general public license version 2", ["gnu general public license", "version 2"]),
    ("lgpl-3.0", "licensed under the gnu lesser general public license version 3", ["lesser general public license", "version 3"]),
    ("agpl-3.0", "licensed under the gnu affero general public license version 3", ["affero general public license", "version 3"]),
    ("cc-by-4.0", "licensed under cc by 4 0", ["cc by 4 0"]),
    ("cc-by-sa-4.0", "licensed under cc by sa 4 0", ["cc by sa 4 0"]),
    ("cc-by-nc-4.0", "licensed under cc by nc 4 0", ["cc by nc 4 0"]),
    ("cc-by-nd-4.0", "licensed under cc by nd 4 0", ["cc by nd 4 0"]),
    ("cc-by-nc-sa-4.0", "licensed under cc by nc sa 4 0", ["cc by nc sa 4 0"]),
    ("cc0-1.0", "cc0 1 0 universal public domain dedication", ["cc0 1 0"]),
    ("mpl-2.0", "subject to the terms of the mozilla public license v 2 0", ["mozilla public license", "2 0"]),
    ("epl-2.0", "made available under the terms of the eclipse public license 2 0", ["eclipse public license", "2 0"]),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software", ["permission is hereby granted", "free of charge", "copy of this software"]),
    ("mit", "licensed under the mit license", ["mit license"]),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ["modify and or distribute this software", "with or without fee"]),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted", ["redistribution and use in source and binary forms"]),
    ("unlicense", "this is free and unencumbered software released into the public domain", ["free and unencumbered software"]),
    ("proprietary", "proprietary and confidential unauthorized copying is strictly prohibited", ["proprietary and confidential"]),
]

# Words too common in running text to be indexed; they still count inside key phrases.
COMMON = set("a all and any are available by for fee free in into is made of or person public released software source subject terms the this to under use version with without work 0 1 2 3 4 v".split())
MOST_POSTINGS = 100_000
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def normalized(text: Column) -> Column:
    """The words of a text, in lower case, with one space between and around them; one space for no words."""
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(lower_ascii(F.coalesce(text, F.lit(""))), NOT_WORD, " ")), F.lit(" "))


def stands_at(words: Column, phrase: str) -> Column:
    """Condition on a position: the words of the phrase stand there (array access beyond the end is null)."""

    def condition(i: Column) -> Column:
        return reduce(lambda a, b: a & b, [F.coalesce(F.get(words, i + k) == w, F.lit(False)) for k, w in enumerate(phrase.split())])

    return condition


def places(line: Column, words: Column, phrase: str) -> Column:
    """Positions of a phrase in the words of a normalized line; only lines that contain it are searched word by word."""
    found = F.filter(F.sequence(F.lit(0), F.size(words) - 1), stands_at(words, phrase))
    return F.when(F.contains(line, F.lit(f" {phrase} ")), found).otherwise(F.array().cast("array<int>"))


def once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Add a column that is computed once per row: the optimizer would copy a plain one into each expression that uses it."""
    return df.select("*", F.explode(F.array(value)).alias(name))


def word_list(templates: list[tuple]) -> list[str]:
    """The indexed words."""
    return sorted({w for _, words, _ in templates for w in words.split()} - COMMON)


def key_words(template: tuple) -> list[str]:
    """The indexed words of a template's key phrases."""
    return sorted({w for phrase in template[2] for w in phrase.split()} - COMMON)


def postings(spark: SparkSession, templates: list[tuple]) -> DataFrame:
    """(word, template, at) for the indexed words."""
    listed = [(w, t, k) for t, (_, words, _) in enumerate(templates) for k, w in enumerate(words.split()) if w not in COMMON]
    if len(listed) > MOST_POSTINGS:
        raise ValueError(f"more than {MOST_POSTINGS} postings; they would no longer be small enough to broadcast")
    return spark.createDataFrame(listed, "word string, template int, at int")


def offset(template: tuple, phrase: str) -> int:
    """The place of a key phrase in its template."""
    line, part = template[1].split(), phrase.split()
    return next(k for k in range(len(line)) if line[k : k + len(part)] == part)


def key_postings(spark: SparkSession, templates: list[tuple]) -> DataFrame:
    """(word, template, at) for the indexed words of the key phrases, at the places where these must stand."""
    listed = [(w, t, offset(template, p) + k) for t, template in enumerate(templates) for p in template[2] for k, w in enumerate(p.split()) if w not in COMMON]
    if {t for _, t, _ in listed} != set(range(len(templates))):
        raise ValueError("every template needs an indexed word in its key phrases; nothing else finds it")
    return spark.createDataFrame(listed, "word string, template int, at int")


def keys_stand(words: Column, start: Column, template: tuple) -> Column:
    """The template's key phrases stand at its places, if it starts at ``start`` (which may lie before the text)."""
    checks = [F.coalesce(F.try_element_at(words, start + offset(template, p) + k + 1) == w, F.lit(False)) for p in template[2] for k, w in enumerate(p.split())]
    inside = [start + offset(template, p) >= 0 for p in template[2]]
    return reduce(lambda a, b: a & b, [*inside, *checks])


def scanned(docs: DataFrame, templates: list[tuple] = TEMPLATES) -> DataFrame:
    """Per document: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score."""
    spark = docs.sparkSession
    rows = once(docs.select("doc_id", "text"), "line", normalized(F.col("text"))).select("doc_id", "line")
    rows = once(rows, "words", F.when(F.length("line") > 2, F.split(F.trim("line"), " ")).otherwise(F.array().cast("array<string>")))
    vocabulary = word_list(templates)
    found = [places(F.col("line"), F.col("words"), phrase) for phrase in PHRASES]
    rows = once(rows, "noted", F.struct(F.array(*found).alias("hits"), F.array_intersect("words", F.array(*map(F.lit, vocabulary))).alias("present")))
    hits_of = F.col("noted.hits")
    every = F.flatten(hits_of)
    labels = F.array(*[F.when(F.size(hits_of[k]) > 0, F.lit(label)) for k, label in enumerate(PHRASES.values())])
    possible = reduce(lambda a, b: a | b, [reduce(lambda a, b: a & b, [F.array_contains("noted.present", w) for w in key_words(t)], F.lit(True)) for t in templates])
    rows = rows.select(
        F.monotonically_increasing_id().alias("row"),
        "doc_id",
        F.size("words").cast("long").alias("n_words"),
        F.size(every).cast("long").alias("n_base"),
        F.array_min(every).cast("long").alias("first_word"),
        F.array_max(every).cast("long").alias("last_word"),
        F.array_sort(F.array_compact(labels)).alias("base_list"),
        F.col("noted.present").alias("present"),
        F.when(possible, F.col("words")).alias("words"),
    )
    stored = materialize(rows, "license-rows")
    index = F.broadcast(postings(spark, templates))
    listed = F.broadcast(spark.createDataFrame([(w,) for w in vocabulary], "word string"))
    words = stored.where("words IS NOT NULL").select("row", F.posexplode("words").alias("pos", "word"))
    hits = materialize(words.join(listed, "word"), "license-hits")
    n = stored.count()
    frequency = stored.select(F.explode("present").alias("word")).groupBy("word").agg(F.count("*").alias("files"))
    weight = F.log(F.lit(n + 1.0) / (F.col("files") + 1)) + 1
    weights = materialize(frequency.select("word", weight.alias("weight")), "license-weights")
    # A template's key phrases stand at their place only where each of their words does, so their rarest word finds every start.
    keys = F.broadcast(key_postings(spark, templates))
    rarest = keys.join(F.broadcast(weights), "word").groupBy("template").agg(F.max(F.struct("weight", "word")).alias("key")).select("template", "key.word")
    starts = hits.join(F.broadcast(keys.join(rarest, ["template", "word"])), "word").select("row", "template", (F.col("pos") - F.col("at")).alias("start")).distinct()
    # All indexed words of the template that stand where it says, for the score.
    totals = index.join(F.broadcast(weights), "word").groupBy("template").agg(F.sum("weight").alias("total"))
    agreeing = hits.join(index, "word").join(F.broadcast(weights), "word").groupBy("row", "template", (F.col("pos") - F.col("at")).alias("start"))
    agreeing = agreeing.agg(F.sum("weight").alias("standing")).join(F.broadcast(totals), "template")
    candidates = starts.join(agreeing, ["row", "template", "start"]).select("row", "template", "start", (F.col("standing") / F.col("total")).alias("share"))
    lines = stored.where("words IS NOT NULL").select("row", "words")
    verdict = F.lit(False)
    label = F.element_at(F.array(*[F.lit(t[0]) for t in templates]), F.col("template") + 1)
    for k, template in enumerate(templates):
        verdict = F.when(F.col("template") == k, keys_stand(F.col("words"), F.col("start"), template)).otherwise(verdict)
    accepted = candidates.join(lines, "row").where(verdict).select("row", label.alias("label"), F.round("share", 6).alias("share"))
    labelled = accepted.groupBy("row").agg(F.collect_set("label").alias("more"), F.max("share").alias("share"))
    done = stored.drop("words", "present").join(labelled, "row", "left")
    all_labels = F.array_sort(F.array_union("base_list", F.coalesce("more", F.array().cast("array<string>"))))
    score = F.greatest(F.coalesce("share", F.lit(0.0)), F.when(F.col("n_base") > 0, 1.0).otherwise(0.0))
    return done.select(
        "doc_id", "n_words", "n_base", "first_word", "last_word",
        F.array_join("base_list", ",").alias("base_labels"),
        F.array_join(all_labels, ",").alias("labels"),
        F.least(score, F.lit(1.0)).alias("score"),
    )
