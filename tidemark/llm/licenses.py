"""License scan by diagonal voting, with DataFrame operations only.

Every pair of neighbouring words of a text is hashed and joined to the pairs of license templates. A match is a
vote for a diagonal: the offset between the place in the text and the place in the template. A short phrase
or a name with its version stands where all its pairs vote for one diagonal. Sentences tolerate changes: diagonals of at least two
votes that lie within ``slack`` words of each other are merged, and a merged span counts if it covers enough of
the template and is not stretched beyond twice its length. Votes compare the words themselves, so a hash
collision cannot vote.

Scale: one pass over the texts. The templates are a fixed list of some hundred pairs, broadcast. Votes and one
row per text are aggregated map-side before they move; nothing else does. A pair that is in every text costs a
row per place while it is counted, and leaves one per diagonal.

Defined cases: null text has no words and no labels; repeated rows are judged alike; words are runs of ASCII
letters, digits and non-ASCII characters with A-Z lower-cased; an empty table gives an empty result; columns
named as ours do not reach the result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import ascii_lower

#: The phrases whose places are counted, and their labels.
PHRASES = [
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
]
#: Names of licenses with their versions, for the method's own labels; all their words must follow each other.
NAMES = [
    ("gnu general public license version 2", "gpl-2.0"),
    ("gnu general public license version 3", "gpl-3.0"),
    ("gnu lesser general public license", "lgpl"),
    ("gnu affero general public license", "agpl"),
    ("apache license version 2 0", "apache-2.0"),
    ("cc by 3 0", "cc-by-3.0"),
    ("cc by 4 0", "cc-by-4.0"),
    ("cc by sa 3 0", "cc-by-sa-3.0"),
    ("cc by sa 4 0", "cc-by-sa-4.0"),
    ("cc by nc 4 0", "cc-by-nc-4.0"),
    ("cc by nd 4 0", "cc-by-nd-4.0"),
    ("cc by nc sa 4 0", "cc-by-nc-sa-4.0"),
    ("cc by nc nd 4 0", "cc-by-nc-nd-4.0"),
    ("cc0 1 0", "cc0-1.0"),
    ("mozilla public license version 2 0", "mpl-2.0"),
    ("eclipse public license", "epl"),
    ("bsd 2 clause", "bsd-2-clause"),
    ("bsd 3 clause", "bsd-3-clause"),
    ("boost software license", "bsl"),
    ("isc license", "isc"),
]
#: Sentences of well-known licenses, which may be changed a little.
TEMPLATES = [
    (
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the "
        "software to deal in the software without restriction including without limitation the rights to use copy modify merge publish "
        "distribute sublicense and or sell copies of the software",
        "mit",
    ),
    (
        "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may "
        "obtain a copy of the license at",
        "apache-2.0",
    ),
    (
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as "
        "published by the free software foundation",
        "gpl",
    ),
    (
        "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as "
        "published by the free software foundation",
        "lgpl",
    ),
    (
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following "
        "conditions are met redistributions of source code must retain the above copyright notice this list of conditions and the "
        "following disclaimer",
        "bsd",
    ),
    ("this work is licensed under a creative commons attribution 4 0 international license", "cc-by-4.0"),
    ("this source code form is subject to the terms of the mozilla public license v 2 0", "mpl-2.0"),
    ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "isc"),
    ("this is free and unencumbered software released into the public domain", "unlicense"),
]
WORDS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def word_array(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(ascii_lower(text), F.lit("")), WORDS), lambda w: w != "")


def template_pairs(spark, templates: list[str]) -> DataFrame:
    """(t, at, a, b): each pair of each template; the empty pair, t = -1, ends every text once."""
    rows = ["(-1, 0, '', '')"]
    for t, text in enumerate(templates):
        words = text.split()
        rows += [f"({t}, {i}, '{a}', '{b}')" for i, (a, b) in enumerate(zip(words, words[1:]))]
    return spark.sql(f"select * from values {', '.join(rows)} as v(t, at, a, b)").withColumn("h", F.xxhash64("a", "b"))


def scan_licenses(docs: DataFrame, phrases=PHRASES, names=NAMES, templates=TEMPLATES, slack: int = 3, least: float = 0.6) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels (arrays, sorted) and score of every row."""
    every = [*phrases, *names, *templates]
    exact = F.col("t") < len(phrases) + len(names)
    base = F.col("t").between(0, len(phrases) - 1)
    of_template = lambda values: F.element_at(F.array(*[F.lit(v) for v in values]), F.col("t") + 1)
    lengths = [len(text.split()) for text, _ in every]

    texts = docs.select("doc_id", word_array(F.col("text")).alias("words"))
    texts = texts.select(F.monotonically_increasing_id().alias("uid"), "doc_id", F.size("words").alias("n"), "words")
    # Only a pair's own words leave the array with it, so a text's cost follows its length.
    firsts, seconds = F.slice("words", 1, F.greatest(F.col("n") - 1, F.lit(0))), F.slice("words", 2, F.greatest(F.col("n") - 1, F.lit(0)))
    pairs = F.concat(F.arrays_zip(firsts.alias("a"), seconds.alias("b")), F.array(F.struct(F.lit("").alias("a"), F.lit("").alias("b"))))
    grams = texts.select("uid", "doc_id", "n", F.posexplode(pairs).alias("pos", "pair"))
    grams = grams.select("uid", "doc_id", "n", "pos", F.col("pair.a").alias("a"), F.col("pair.b").alias("b")).withColumn("h", F.xxhash64("a", "b"))
    votes = grams.join(F.broadcast(template_pairs(docs.sparkSession, [text for text, _ in every])), ["h", "a", "b"])
    diagonals = votes.groupBy("uid", "doc_id", "n", "t", (F.col("pos") - F.col("at")).alias("diagonal")).agg(
        F.collect_set("at").alias("hit"), F.min("pos").alias("low"), F.max("pos").alias("high")
    )
    pairs_of = of_template(lengths) - 1
    diagonals = diagonals.where(
        F.when(F.col("t") < 0, F.lit(True)).when(exact, F.size("hit") == pairs_of).otherwise(F.size("hit") >= F.least(F.lit(2), pairs_of))
    )

    order = Window.partitionBy("uid", "t").orderBy("diagonal")
    apart = F.col("diagonal") - F.lag("diagonal").over(order) > F.when(exact, F.lit(0)).otherwise(F.lit(slack))
    spans = diagonals.withColumn("span", F.sum(F.coalesce(apart.cast("int"), F.lit(0))).over(order))
    spans = spans.groupBy("uid", "doc_id", "n", "t", "span").agg(
        F.size(F.array_distinct(F.flatten(F.collect_list("hit")))).alias("hits"), F.min("low").alias("low"), F.max("high").alias("high")
    )
    whole = (F.col("hits") >= least * pairs_of) & (F.col("high") + 2 - F.col("low") <= 2 * of_template(lengths))
    spans = spans.withColumn("is_base", base).withColumn("counts", F.when(F.col("t") < 0, F.lit(False)).otherwise(exact | whole))
    spans = spans.withColumn("label", F.when(F.col("t") >= 0, of_template([label for _, label in every])))
    spans = spans.withColumn("share", F.when(F.col("counts"), F.col("hits") / pairs_of).otherwise(F.lit(0.0)))
    return (
        spans.groupBy("uid", "doc_id", "n")
        .agg(
            F.count(F.when(F.col("is_base"), 1)).alias("n_base"),
            F.min(F.when(F.col("is_base"), F.col("low"))).cast("long").alias("first_word"),
            F.max(F.when(F.col("is_base"), F.col("low"))).cast("long").alias("last_word"),
            F.array_sort(F.collect_set(F.when(F.col("is_base"), F.col("label")))).alias("base_labels"),
            F.array_sort(F.collect_set(F.when(F.col("counts"), F.col("label")))).alias("labels"),
            F.max("share").alias("score"),
        )
        .select("doc_id", F.col("n").cast("long").alias("n_words"), "n_base", "first_word", "last_word", "base_labels", "labels", "score")
    )
