"""License scan by diagonal voting over word k-grams.

Every run of `K` words of a document is hashed and joined to the positions at which the
license templates hold the same run; the words themselves are compared where a hash meets.
Position less template position is the diagonal on which a copy of the template lies, and
each meeting is a vote for it. Neighbouring diagonals of a template are merged to a span, since
a word put in or left out moves the rest of a copy by one. A span is verified: each template
position counts once, by its vote nearest to the span's strongest diagonal, not further from it than
`DRIFT` of the template's length, and only if it stands behind the position before it. The share of the
template's positions that remain decides. Of licenses that differ in a word, such as those with and without
NonCommercial, a copy must also hold the run that tells its own from the others (`DECISIVE`), in order.

A phrase is a template of which only full diagonals count: there its words stand one after
another. DataFrame functions only. The templates are fixed values of bounded number, so they
are the broadcast side; each document also sends one row of its own through the same join
(hash 0), so words are counted in the same pass and nothing but votes is shuffled.

Defined cases: a null or empty text has no words, places or labels and score 0; repeated or
null document ids stay rows of their own; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tarnwick.session import table

K = 3
#: Diagonals no further apart belong to one copy.
NEAR = 3
#: A vote belongs to a copy if its diagonal is within NEAR words and this share of the template's runs.
DRIFT = 0.25
#: Share of a template's runs that makes a copy of it.
COPY = 0.8

# Phrases and their labels.
PHRASES = (
    ("mit", "under the mit license"),
    ("apache-2", "apache license version 2"),
    ("cc-by-nc", "cc by nc"),
)
# Sentences of public licenses, their usual notices, and the whole texts of short licenses.
TEMPLATES = (
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("apache-2", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("lgpl", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License"),
    ("mpl-2", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("cc-by-nd", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License"),
    ("cc-by-nc-sa", "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License"),
    ("cc-by-nc-nd", "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License"),
    ("agpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation"),
    ("cc0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work"),
    ("mit", "SPDX-License-Identifier: MIT"),
    ("apache-2", "SPDX-License-Identifier: Apache-2.0"),
    ("gpl", "SPDX-License-Identifier: GPL-3.0-or-later"),
    (
        "mit",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"),"
        " to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense,"
        " and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"
        " The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."
        " THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,"
        " FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY,"
        " WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ),
    (
        "isc",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted,"
        " provided that the above copyright notice and this permission notice appear in all copies."
        " THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS."
        " IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS,"
        " WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    ),
    (
        "bsd",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"
        " 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."
        " 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation"
        " and/or other materials provided with the distribution."
        " THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO,"
        " THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED."
        " IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES"
        " (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION)"
        " HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE)"
        " ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    ),
    (
        "zlib",
        "This software is provided 'as-is', without any express or implied warranty."
        " In no event will the authors be held liable for any damages arising from the use of this software."
        " Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely,"
        " subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software."
        " If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required."
        " 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software."
        " 3. This notice may not be removed or altered from any source distribution.",
    ),
    (
        "unlicense",
        "This is free and unencumbered software released into the public domain."
        " Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary,"
        " for any purpose, commercial or non-commercial, and by any means.",
    ),
)

# By label, the run of K words that its near relatives don't have.
DECISIVE = {
    "gpl": "gnu general public",
    "lgpl": "gnu lesser general",
    "agpl": "gnu affero general",
    "cc-by": "attribution 4 0",
    "cc-by-sa": "attribution sharealike 4",
    "cc-by-nc": "attribution noncommercial 4",
    "cc-by-nd": "attribution noderivatives 4",
    "cc-by-nc-sa": "noncommercial sharealike 4",
    "cc-by-nc-nd": "noncommercial noderivatives 4",
}

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: str) -> Column:
    """Words of a text column: A-Z lowered, cut at every ASCII character that is no letter or digit; none for null."""
    return F.array_remove(F.split(F.translate(F.coalesce(F.col(text).cast("string"), F.lit("")), _UPPER, _LOWER), _BREAK), "")


def _runs() -> Column:
    """Hashes of all runs of K words of the column `words`, in order."""
    return F.expr(f"transform(slice(words, 1, greatest(0, size(words) - {K - 1})), (w, i) -> xxhash64(w, " + ", ".join(f"words[i + {j}]" for j in range(1, K)) + "))")


def template_positions(spark: SparkSession, phrases, templates) -> DataFrame:
    """(hash, run, template, label, phrase, tpos, runs, decisive, needs): one row for each run of each template, and one with hash 0.

    needs tells whether a template has a decisive run at all, decisive whether this is it.
    """
    rows = [(i, label, i < len(phrases), text, "" if i < len(phrases) else DECISIVE.get(label, "")) for i, (label, text) in enumerate([*phrases, *templates])]
    df = spark.createDataFrame(rows, "template int, label string, phrase boolean, text string, mark string").withColumn("words", words("text"))
    df = df.withColumn("needs", F.expr("mark != '' and contains(concat(' ', array_join(words, ' '), ' '), concat(' ', mark, ' '))"))
    df = df.withColumn("hashes", _runs()).filter(F.size("hashes") > 0)
    df = df.select("template", "label", "phrase", F.size("hashes").alias("runs"), "words", "mark", "needs", F.posexplode("hashes").alias("tpos", "hash"))
    df = df.withColumn("run", F.slice("words", F.col("tpos") + 1, K)).withColumn("decisive", F.col("needs") & (F.array_join("run", " ") == F.col("mark")))
    df = df.select("hash", "run", "template", "label", "phrase", "tpos", "runs", "decisive", "needs")
    own = spark.createDataFrame([(0, [], -1, "", False, 0, 1, False, False)], df.schema)
    return df.unionByName(own)


def votes(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", phrases=PHRASES, templates=TEMPLATES) -> DataFrame:
    """(row, doc_id, n_words, template, label, phrase, runs, tpos, decisive, needs, diagonal), one row a vote: template -1 is the document's own row."""
    known = F.broadcast(template_positions(docs.sparkSession, phrases, templates))
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("doc_id"), words(text_col).alias("words"))
    rows = rows.withColumn("hashes", F.concat(F.array(F.lit(0).cast("long")), _runs()))
    rows = rows.select("row", "doc_id", "words", F.posexplode("hashes").alias("at", "hash")).join(known, "hash")
    rows = rows.filter(((F.col("at") == 0) & (F.col("template") < 0)) | ((F.col("at") > 0) & (F.slice("words", F.greatest(F.col("at"), F.lit(1)), K) == F.col("run"))))
    n_words = F.when(F.col("template") < 0, F.size("words")).alias("n_words")
    rows = rows.select("row", "doc_id", n_words, "template", "label", "phrase", "runs", "tpos", "decisive", "needs", (F.col("at") - 1 - F.col("tpos")).alias("diagonal"))
    # all votes of a document lie in one task already; dealt by document once, the later steps need no other exchange
    return rows.repartition("row")


def spans(found: DataFrame) -> DataFrame:
    """Votes with neighbouring diagonals of a template merged: (row, doc_id, n_words, template, label, phrase, part, places, first, last, share, decided)."""
    order = Window.partitionBy("row", "template").orderBy("diagonal")
    step = (F.col("diagonal") - F.lag("diagonal").over(order) > NEAR).cast("int")
    merged = found.withColumn("step", F.coalesce(step, F.lit(0))).withColumn("part", F.sum("step").over(order))
    merged = merged.withColumn("votes", F.count("*").over(Window.partitionBy("row", "template", "part", "diagonal")))
    strongest = Window.partitionBy("row", "template", "part").orderBy(F.desc("votes"), "diagonal")
    merged = merged.withColumn("off", F.abs(F.col("diagonal") - F.first("diagonal").over(strongest)))
    # each position of the template once
    own = ["row", "doc_id", "template", "label", "phrase", "runs", "needs", "part"]
    full = F.col("phrase") & (F.col("votes") == F.col("runs")) & (F.col("tpos") == 0)
    near = F.col("off") <= NEAR + DRIFT * F.col("runs")
    placed = merged.groupBy(*own, "tpos").agg(
        F.max("n_words").alias("n_words"),
        F.max("decisive").alias("decisive"),
        F.min(F.when(near, F.struct("off", "diagonal"))).alias("best"),
        F.sum(full.cast("long")).alias("places"),
        F.min(F.when(full, F.col("diagonal"))).alias("first"),
        F.max(F.when(full, F.col("diagonal"))).alias("last"),
    )
    at = F.when(F.col("best").isNotNull(), F.col("best.diagonal") + F.col("tpos"))
    along = Window.partitionBy("row", "template", "part").orderBy("tpos").rowsBetween(Window.unboundedPreceding, -1)
    placed = placed.withColumn("at", at).withColumn("before", F.last("at", ignorenulls=True).over(along))
    in_order = F.col("at").isNotNull() & (F.col("before").isNull() | (F.col("at") > F.col("before")))
    return placed.groupBy(*own).agg(
        F.max("n_words").alias("n_words"),
        F.sum("places").alias("places"),
        F.min("first").alias("first"),
        F.max("last").alias("last"),
        (F.sum(in_order.cast("long")) / F.first("runs")).alias("share"),
        (~F.col("needs") | F.max(in_order & F.col("decisive"))).alias("decided"),
    )


def scan(docs: DataFrame, **options) -> DataFrame:
    """One row for each row of `docs`: words, places of phrases, labels, and the best verified share as score."""
    s = spans(votes(docs, **options))
    base = F.col("phrase") & (F.col("places") > 0)
    copy = ~F.col("phrase") & (F.col("template") >= 0) & (F.col("share") >= COPY) & F.col("decided")
    joined = lambda keep: F.array_join(F.array_sort(F.collect_set(F.when(keep, F.col("label")))), ",")
    share = F.when(base, 1.0).when(~F.col("phrase") & (F.col("template") >= 0), F.col("share"))
    return s.groupBy("row", "doc_id").agg(
        F.max("n_words").cast("long").alias("n_words"),
        F.coalesce(F.sum(F.when(base, F.col("places"))), F.lit(0)).cast("long").alias("n_base"),
        F.min("first").cast("long").alias("first_word"),
        F.max("last").cast("long").alias("last_word"),
        joined(base).alias("base_labels"),
        joined(base | copy).alias("labels"),
        F.round(F.coalesce(F.max(share), F.lit(0.0)), 6).alias("score"),
    ).drop("row")


def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Phrases and license templates in every whole document."""
    return scan(table(spark, sf_dir, "documents"))


def _sql() -> str:
    quoted = lambda text: text.replace("'", "''")
    rows = ", ".join(f"({i}, '{label}', {str(i < len(PHRASES)).lower()}, '{quoted(text)}', '{'' if i < len(PHRASES) else DECISIVE.get(label, '')}')" for i, (label, text) in enumerate([*PHRASES, *TEMPLATES]))
    cut = lambda text: f"regexp_extract_all(translate(coalesce({text}, ''), '{_UPPER}', '{_LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
    runs = f"unnest(range(cast(greatest(0, len(w) - {K - 1}) as bigint)))"
    return f"""
with t as (
  select template, label, phrase, mark, {cut("text")} as w from (values {rows}) v(template, label, phrase, text, mark)
), tp as (
  select template, label, phrase, len(w) - {K - 1} as runs, tpos, array_to_string(w[tpos + 1:tpos + {K}], ' ') as run,
    mark <> '' and array_to_string(w[tpos + 1:tpos + {K}], ' ') = mark as decisive, mark <> '' and contains(' ' || array_to_string(w, ' ') || ' ', ' ' || mark || ' ') as needs
  from (select *, {runs} as tpos from t)
), d as (
  select row_number() over () as r, doc_id, {cut("text")} as w from documents
), dp as (
  select r, pos, array_to_string(w[pos + 1:pos + {K}], ' ') as run from (select r, w, {runs} as pos from d)
), v as (
  select r, template, label, phrase, runs, tpos, decisive, needs, pos - tpos as diagonal, count(*) over (partition by r, template, pos - tpos) as votes from dp join tp using (run)
), m as (
  select *, sum(step) over (partition by r, template order by diagonal) as part
  from (select *, case when diagonal - lag(diagonal) over (partition by r, template order by diagonal) > {NEAR} then 1 else 0 end as step from v)
), o as (
  select *, phrase and votes = runs and tpos = 0 as whole, abs(diagonal - first_value(diagonal) over (partition by r, template, part order by votes desc, diagonal)) as off from m
), q as (
  select r, template, label, phrase, runs, needs, part, tpos, bool_or(decisive) as decisive, sum(whole::int) as places, min(diagonal) filter (whole) as f, max(diagonal) filter (whole) as l,
    arg_min(diagonal, (off, diagonal)) filter (off <= {NEAR} + {DRIFT} * runs) + tpos as place
  from o group by r, template, label, phrase, runs, needs, part, tpos
), w as (
  select *, last_value(place ignore nulls) over (partition by r, template, part order by tpos rows between unbounded preceding and 1 preceding) as before from q
), s as (
  select r, template, label, phrase, part, sum(places) as places, min(f) as f, max(l) as l,
    count(*) filter (place is not null and (before is null or place > before)) / max(runs) as share,
    not bool_or(needs) or coalesce(bool_or(decisive) filter (place is not null and (before is null or place > before)), false) as decided
  from w group by r, template, label, phrase, part
), g as (
  select r, sum(places) filter (phrase) as n_base, min(f) as f, max(l) as l,
    array_to_string(list_sort(list(distinct label) filter (phrase and places > 0)), ',') as base_labels,
    array_to_string(list_sort(list(distinct label) filter ((phrase and places > 0) or (not phrase and share >= {COPY} and decided))), ',') as labels,
    max(case when phrase then case when places > 0 then 1.0 end else share end) as score
  from s group by r
)
select doc_id, cast(len(w) as bigint) as n_words, cast(coalesce(n_base, 0) as bigint) as n_base, cast(f as bigint) as first_word, cast(l as bigint) as last_word,
  coalesce(base_labels, '') as base_labels, coalesce(labels, '') as labels, round(cast(coalesce(score, 0) as double), 6) as score
from d left join g using (r)
"""


OP9_SQL = _sql()
