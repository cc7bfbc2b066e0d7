"""Operator 9: licence scan by sparse TF-IDF cosine to templates, with directory inheritance. SQL functions only.

Texts are cut into units (lines, and sentences within lines); units that hold
a licence word are compared with the templates. Term weights are tf * idf over
the distinct units of the corpus and the templates, and a unit has the licence
of its nearest template from cosine ``THRESHOLD`` on. Equal units are compared
once, so a line that a third of all files hold is one entry.

A template counts only if the unit also holds its licence's name, version and
clauses (``NAMES``), and a unit within ``MARGIN`` of templates of two licences
has none. The sentence that all BSD licences begin with takes its clauses from
the file. A line with an SPDX identifier has what it names, listed here or not
("-only", "-or-later" and "+" go; several identifiers stay an expression).
A line that denies a licence is passed over. In a file that names one licence
and has no matched line, a notice broken over lines is joined and compared alike.

Whole files and their header blocks (the leading comment lines) that hold the
marks of a licence's full text are compared with the full texts (``FULL``,
``license_texts/``) by the same cosine, with the idf of the full texts. From
``FULL_LEAST`` on the whole file's licence goes before the header's, and that
before the lines'. AGPL-3.0 has no text of its own here: it is told from
GPL-3.0 by its title and compared with that text, from which it hardly differs.

A file is a licence file if its base name says so, or, unless it is named like a
program (``PROGRAM_FILE``), if its whole text is near a full text or matched
units make up ``COVER`` of its words. Its licence holds for its directory: a file
without a licence of its own takes that of the nearest ancestor directory that
has one, found by equi-joins on the ancestors of the distinct directories. A
file that claims a licence not recognised here (``CLAIM``) takes none.

Null and empty texts have no units; a null path inherits nothing. Repeated
rows each give a row. Ties go to the licence first in the alphabet. Empty
tables give empty results.
"""

from __future__ import annotations

import math
import pkgutil
import re
from collections import Counter

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ratebook.llm.common import col, staged

THRESHOLD = 0.5
COVER = 0.9
UNIT_BREAK = r"\n|[.;][ \t\r\n]+"
VERSION = r"\b([vV])\.[ \t]+([0-9])"  # "v. 2" ends no sentence
LICENCE_WORD = r"(?i)licen[cs]|copyright|spdx|public domain|permission is hereby|redistribution and use"
LICENCE_FILE = r"(?i)^(licen[cs]e|copying|unlicense|notice)([.-].*)?$"
TERM_BREAK = r"[^a-z0-9.+-]+"
FULL_LEAST = 0.9
NEAR_LINES = rf"(?im)^(?:[^\n]*+\n)?[^\n]*?(?:{LICENCE_WORD.removeprefix('(?i)')})[^\n]*+(?:\n[^\n]*+){{0,2}}"
COMMENT_MARK = r"(?:^|\n)[ \t\r]*(?:#+|//+|/?\*+/?|--|;+|%+|<!--|\"\"\")?[ \t]*"
COMMENT_LINE = r"^[ \t\r]*($|#|//|/?\*|--|;|%|<!--|\"\"\")"
#: Fixed texts: usual notices of each licence.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted"),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0"),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0"),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("CC0-1.0", "Dedicated to the public domain under CC0 1.0 Universal"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-or-later"),
    ("LGPL-3.0", "Licensed under the GNU Lesser General Public License, version 3"),
    ("MIT", "Released under the MIT License"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software"),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
)
#: Usual notices of their neighbours. They have the idf of the corpus and ``TEMPLATES``.
NEIGHBOURS = (
    ("AGPL-3.0", "Licensed under the GNU Affero General Public License, version 3"),
    ("BSD-2-Clause", "Licensed under the BSD 2-Clause License"),
    *((f"CC-BY-{short}-4.0", text) for short, long in (("NC-ND", "NonCommercial-NoDerivatives"), ("NC-SA", "NonCommercial-ShareAlike"),
                                                       ("ND", "NoDerivatives"), ("SA", "ShareAlike"))
      for text in (f"Licensed under CC BY-{short} 4.0",
                   f"This work is licensed under a Creative Commons Attribution-{long} 4.0 International License")),
    ("GPL-1.0", "This work is licensed under the GNU General Public License, version 1"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2"),
    *((f"{short}-{v}", f"under the terms of the GNU {word}General Public License as published by the Free Software Foundation, "
       f"either version {v.removesuffix('.0')} of the License, or any later version")
      for short, word, versions in (("GPL", "", ("2.0", "3.0")), ("LGPL", "Lesser ", ("2.1", "3.0")), ("AGPL", "Affero ", ("3.0",)))
      for v in versions),
    ("ISC", "Released under the ISC License"),
    ("LGPL-2.0", "Licensed under the GNU Library General Public License, version 2"),
    ("LGPL-2.1", "Licensed under the GNU Lesser General Public License, version 2.1"),
    ("MPL-1.1", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 1.1"),
    ("Zlib", "Released under the zlib License"),
)
MARGIN = 0.05


def _gnu(word: str, short: str, version: str) -> str:
    v, name = rf"{version}(\.0)?(\+|-or-later|-only)?", rf"gnu {word}general public licen[cs]e"
    return (rf"({name} (as published by the free software foundation )?(either )?(version |v ?)?{v}|version {v} of the {name}"
            rf"|(gnu )?{short}[ -]?(version |v ?)?{v})")


def _called(name: str) -> str:
    return rf"({name}[ -]licen[cs]ed?|licen[cs]ed? (under )?(the )?(terms of the )?{name})"


def _cc(short: str, long: str) -> str:
    return rf"(cc[ -]by{short}|creative commons attribution{long})[ -](license |international )?(version |v ?)?4\.0"


#: Per licence: what a notice's terms, in one line, must hold.
NAMES = {
    "AGPL-3.0": _gnu("affero ", "agpl", "3"), "GPL-1.0": _gnu("", "gpl", "1"), "GPL-2.0": _gnu("", "gpl", "2"), "GPL-3.0": _gnu("", "gpl", "3"),
    "LGPL-2.0": _gnu("(library|lesser) ", "lgpl", "2"), "LGPL-2.1": _gnu("lesser ", "lgpl", r"2\.1"), "LGPL-3.0": _gnu("lesser ", "lgpl", "3"),
    "Apache-2.0": r"(apache[ -](software )?(licen[cs]e )?(version |v ?)?2(\.0)?|version 2(\.0)? of the apache licen[cs]e)",
    "BSD-2-Clause": r"(bsd[ -]?(2|two)[ -]clause|(2|two)[ -]clause bsd|simplified bsd)",
    "BSD-3-Clause": r"(bsd[ -]?(3|three)[ -]clause|(3|three)[ -]clause bsd|(new|modified|revised) bsd)",
    "CC-BY-4.0": _cc("", ""), "CC-BY-NC-4.0": _cc("[ -]nc", "[ -]noncommercial"),
    "CC-BY-NC-ND-4.0": _cc("[ -]nc[ -]nd", "[ -]noncommercial[ -]noderiv(ativ|at)es"),
    "CC-BY-NC-SA-4.0": _cc("[ -]nc[ -]sa", "[ -]noncommercial[ -]sharealike"),
    "CC-BY-ND-4.0": _cc("[ -]nd", "[ -]noderiv(ativ|at)es"), "CC-BY-SA-4.0": _cc("[ -]sa", "[ -]sharealike"),
    "CC0-1.0": r"(cc0([ -]1\.0)?|creative commons zero)",
    "ISC": _called("isc"), "Zlib": _called("zlib( libpng)?"),
    "MIT": rf"({_called('(mit( x11| open source)?|expat)')}|permission is hereby granted free of charge to any person obtaining a copy)",
    "MPL-1.1": r"(mozilla public licen[cs]e |mpl[ -]?)(version |v ?)?1\.1", "MPL-2.0": r"(mozilla public licen[cs]e |mpl[ -]?)(version |v ?)?2(\.0)?",
}
#: The sentence of all BSD licences, and what tells them apart in a file.
BSD_START = " redistribution and use in source and binary forms "
BSD_CLAUSES = (("BSD-4-Clause", " all advertising materials "), ("BSD-3-Clause", " endorse or promote "),
               ("BSD-2-Clause", " redistributions in binary form must reproduce "))
#: A line that puts its file under some licence, known here or not; one that denies a licence; names of program files.
CLAIM = r"(?i)licen[cs]ed (under|to)|under the terms|spdx-license-identifier|all rights reserved|permission is hereby"
DENIED = r"(?i)\b(not|never|no longer|nor) (licen[cs]ed|released|covered|distributed|available|subject|under)\b"
PROGRAM_FILE = r"(?i)\.(py|pyi|ipynb|c|h|cc|cpp|hpp|cs|java|kt|scala|js|jsx|ts|tsx|go|rs|rb|php|pl|sh|bash|sql|swift|m|r|lua|css|html|xml|json|ya?ml|toml)$"
SPDX_ID = r"\(*[a-z0-9][a-z0-9.+:-]*\)*"
SPDX = rf"(?i)spdx-license-identifier:[ \t]*({SPDX_ID}([ \t]+(and|or|with)[ \t]+{SPDX_ID})*)"
_BSD = ("redistribution and use in source and binary forms", "redistributions in binary form must reproduce")
_GPL = "terms and conditions for copying distribution and modification"
#: Per licence: its full text's file, phrases of terms that a text must hold, and phrases that it must not.
FULL = {
    "AGPL-3.0": ("GPL-3.0", ("gnu affero general public license version 3 19 november 2007", "terms and conditions"), ()),
    "Apache-2.0": ("Apache-2.0", ("apache license version 2.0", "terms and conditions for use reproduction and distribution"), ()),
    "BSD-2-Clause": ("BSD-2-Clause", _BSD, ("endorse or promote", "all advertising materials")),
    "BSD-3-Clause": ("BSD-3-Clause", (*_BSD, "endorse or promote"), ("all advertising materials",)),
    "CC0-1.0": ("CC0-1.0", ("cc0 1.0 universal", "statement of purpose"), ()),
    "GPL-1.0": ("GPL-1.0", ("gnu general public license version 1 february 1989", _GPL), ()),
    "GPL-2.0": ("GPL-2.0", ("gnu general public license version 2 june 1991", _GPL), ()),
    "GPL-3.0": ("GPL-3.0", ("gnu general public license version 3 29 june 2007", "terms and conditions"), ()),
    "ISC": ("ISC", ("permission to use copy modify", "distribute this software for any purpose with or without fee is hereby "
                    "granted provided that the above copyright notice"), ()),
    "LGPL-2.0": ("LGPL-2.0", ("gnu library general public license version 2 june 1991", _GPL), ()),
    "LGPL-2.1": ("LGPL-2.1", ("gnu lesser general public license version 2.1 february 1999", _GPL), ()),
    "LGPL-3.0": ("LGPL-3.0", ("gnu lesser general public license version 3 29 june 2007", "additional definitions"), ()),
    "MIT": ("MIT", ("permission is hereby granted free of charge to any person obtaining a copy of this software",
                    "the above copyright notice and this permission notice"), ()),
    "MPL-1.1": ("MPL-1.1", ("mozilla public license version 1.1", "definitions"), ()),
    "MPL-2.0": ("MPL-2.0", ("mozilla public license version 2.0", "definitions"), ()),
    "Zlib": ("Zlib", ("provided as-is without any express or implied warranty", "altered source versions must be plainly marked"), ()),
}


def _terms(text: Column) -> Column:
    return F.filter(F.transform(F.split(F.lower(text), TERM_BREAK), lambda t: F.btrim(t, F.lit(".-"))), lambda t: t != "")


def _weights(texts: DataFrame, idf: DataFrame, unseen: float) -> DataFrame:
    """(unit, term, weight) of unit-length vectors; terms without an idf have that of a term in no unit."""
    tf = texts.select("unit", F.explode(_terms(F.col("unit"))).alias("term")).groupBy("unit", "term").count()
    raw = tf.join(idf, "term", "left").select("unit", "term", (F.col("count") * F.coalesce("idf", F.lit(unseen))).alias("w"))
    norm = raw.groupBy("unit").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return raw.join(norm, "unit").select("unit", "term", (F.col("w") / F.col("norm")).alias("weight"))


def _named(plain: Column) -> Column:
    """The licences whose names a text's terms hold."""
    return F.filter(F.array(*[F.when(F.rlike(plain, F.lit(f" {name} ")), F.lit(k)) for k, name in NAMES.items()]), lambda k: k.isNotNull())


def _spdx(unit: Column) -> Column:
    """What an SPDX line names, in the spelling used here; empty if it is no such line."""
    known = F.create_map(*[F.lit(x) for k in sorted({*NAMES, *FULL}) for x in (k.lower(), k)],
                         *[F.lit(x) for k in ("and", "or", "with") for x in (k, k.upper())])
    found = F.regexp_replace(F.regexp_replace(F.regexp_extract(unit, SPDX, 1), r"[ \t]+", " "), "[.:-]+$", "")
    plain = F.regexp_replace(F.regexp_replace(found, r"^\(([^()]*)\)$", "$1"), r"(?i)(-only|-or-later|\+)(?=[ )]|$)", "")
    parts = F.split(F.regexp_replace(F.regexp_replace(plain, r"\(", "( "), r"\)", " )"), " ")
    named = F.array_join(F.transform(parts, lambda t: F.coalesce(F.try_element_at(known, F.lower(t)), t)), " ")
    named = F.regexp_replace(F.regexp_replace(named, r"\( ", "("), r" \)", ")")
    return F.when(F.lower(named).isin("none", "noassertion"), "").otherwise(named)


def matched_units(units: DataFrame, counted: DataFrame) -> DataFrame:
    """(unit, license, score, any_bsd) of the distinct ``units`` that lie near a template; ``any_bsd``: the file tells which BSD licence.
    The idf is that of the distinct units ``counted`` and the templates."""
    spark = units.sparkSession
    templates = spark.createDataFrame(list(TEMPLATES), "license string, unit string")
    every = templates.unionByName(spark.createDataFrame(list(NEIGHBOURS), "license string, unit string"))
    corpus = counted.unionByName(templates.select("unit")).distinct()
    n = corpus.count()
    unseen = math.log(1.0 + n) + 1.0
    idf = (corpus.select(F.explode(F.array_distinct(_terms(F.col("unit")))).alias("term")).groupBy("term").count()
           .select("term", (F.log((1.0 + F.lit(n)) / (1.0 + F.col("count"))) + 1.0).alias("idf")))
    new = every.select(F.explode(_terms(F.col("unit"))).alias("term")).distinct().join(idf, "term", "left_anti")
    idf = idf.unionByName(new.select("term", F.lit(unseen).alias("idf")))
    near = _weights(every.select("unit").distinct(), idf, unseen).join(every, "unit").select(
        F.col("unit").alias("template"), "license", "term", F.col("weight").alias("t"))
    both = _weights(units, idf, unseen).join(F.broadcast(near), "term")  # the templates are a fixed, small table
    cosine = both.groupBy("unit", "template", "license").agg(F.sum(F.col("weight") * F.col("t")).alias("score"))
    plain = _plain(F.col("unit"))
    begins = F.contains(plain, F.lit(BSD_START))
    names = _named(plain)
    any_bsd = begins & (F.size(F.filter(names, lambda k: F.startswith(k, F.lit("BSD")))) == 0)
    allowed = cosine.where(F.array_contains(names, F.col("license")) | (any_bsd & (F.col("license") == "BSD-3-Clause")))
    each = allowed.groupBy("unit", "license").agg(F.round(F.max("score"), 6).alias("score"))
    best = each.groupBy("unit").agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("minus"), "license"))).alias("b"))
    clear = (F.size("b") < 2) | (F.try_element_at("b", F.lit(2))["minus"] - F.col("b")[0]["minus"] >= MARGIN)
    read = best.where(clear & (-F.col("b")[0]["minus"] >= THRESHOLD)).select(
        "unit", F.col("b")[0]["license"].alias("license"), (-F.col("b")[0]["minus"]).alias("score"), any_bsd.alias("any_bsd"))
    said = units.where(F.rlike("unit", F.lit(SPDX))).select(
        "unit", _spdx(F.col("unit")).alias("license"), F.lit(1.0).alias("score"), F.lit(False).alias("any_bsd"))
    return read.where(~F.rlike("unit", F.lit(SPDX))).unionByName(said.where("license <> ''"))


def full_text(name: str) -> str:
    return pkgutil.get_data("ratebook.llm", f"license_texts/{name}.txt").decode()


def _plain(text: Column) -> Column:
    """The terms of a text in one line."""
    return F.concat(F.lit(" "), F.array_join(_terms(text), " "), F.lit(" "))


def _held_by(plain: Column) -> Column:
    """The licences whose marks a text's terms hold."""
    def marked(must, never):
        out = F.lit(True)
        for phrase in must:
            out = out & F.contains(plain, F.lit(f" {phrase} "))
        for phrase in never:
            out = out & ~F.contains(plain, F.lit(f" {phrase} "))
        return out
    return F.filter(F.array(*[F.when(marked(must, never), F.lit(k)) for k, (_, must, never) in FULL.items()]), lambda k: k.isNotNull())


def _vocabulary(spark: SparkSession) -> tuple[DataFrame, float]:
    """(term, idf, weights): each term's weight in each full text, in the order of ``FULL``; and the idf of other terms."""
    texts = {f: Counter(t for t in (x.strip(".-") for x in re.split(TERM_BREAK, full_text(f).lower())) if t)
             for f in sorted({f for f, _, _ in FULL.values()})}
    df = Counter(t for terms in texts.values() for t in terms)
    idf = {t: math.log((1 + len(texts)) / (1 + n)) + 1 for t, n in df.items()}
    norm = {f: math.sqrt(sum((n * idf[t]) ** 2 for t, n in terms.items())) for f, terms in texts.items()}
    rows = [(t, idf[t], [texts[f][t] * idf[t] / norm[f] for f, _, _ in FULL.values()]) for t in sorted(idf)]
    return spark.createDataFrame(rows, "term string, idf double, weights array<double>"), math.log(1 + len(texts)) + 1


def matched_texts(parts: DataFrame) -> DataFrame:
    """(__file, part, license, score) of ``parts`` (__file, part, plain, held) that lie near the full text of a licence they may be."""
    vocabulary, unseen = _vocabulary(parts.sparkSession)
    tf = (parts.select("__file", "part", "held", F.explode(F.filter(F.split("plain", " "), lambda t: t != "")).alias("term"))
          .groupBy("__file", "part", "held", "term").count())
    w = F.col("count") * F.coalesce("idf", F.lit(unseen))
    sums = (tf.join(F.broadcast(vocabulary), "term", "left")  # the full texts are a fixed, small table
            .groupBy("__file", "part", "held").agg(
        F.sqrt(F.sum(w * w)).alias("norm"), *[F.sum(w * F.col("weights")[i]).alias(f"s{i}") for i in range(len(FULL))]))
    each = F.array(*[F.struct(F.round(-F.coalesce(F.col(f"s{i}"), F.lit(0.0)) / F.col("norm"), 6).alias("minus"), F.lit(k).alias("license"))
                     for i, k in enumerate(FULL)])
    best = F.array_min(F.filter(each, lambda x: F.array_contains(F.col("held"), x["license"])))
    return (sums.select("__file", "part", best.alias("b")).select("__file", "part", "b.license", (-F.col("b.minus")).alias("score"))
            .where(F.col("score") >= FULL_LEAST))


def _joined(text: Column) -> Column:
    """The sentences with a licence word of such lines, each joined with the line before and the two after it; one pass over the text."""
    plain = F.regexp_replace(text, VERSION, "$1 $2")
    near = F.regexp_extract_all(plain, F.lit(NEAR_LINES), F.lit(0))
    parts = F.flatten(F.transform(near, lambda x: F.split(F.regexp_replace(x, COMMENT_MARK, " "), r"[.;][ \t\r]+")))
    return F.array_distinct(F.transform(F.filter(parts, lambda u: F.rlike(u, F.lit(LICENCE_WORD))), lambda u: F.btrim(u)))


def _header(text: Column) -> Column:
    """The comment and empty lines that a text begins with."""
    lines = F.split(text, "\n")
    code = F.array_position(F.transform(lines, lambda x: F.rlike(x, F.lit(COMMENT_LINE))), False)
    return F.array_join(F.when(code > 0, F.slice(lines, F.lit(1), (code - 1).cast("int"))).otherwise(lines), "\n")


def _ancestors(directory: Column) -> Column:
    """A directory ('/a/b/') and all above it."""
    parts = F.split(directory, "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.concat(F.array_join(F.slice(parts, 1, n), "/"), F.lit("/")))


def scan_licenses(df: DataFrame, path: Column, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns (default: all but the text) with own_license, own_score, license and found
    ('text', 'ancestor' or null)."""
    own_names = ("own_license", "own_score", "license", "found")
    keep = [c for c in (df.columns if keep is None else keep) if c != text_col and c.lower() not in own_names]
    text = F.coalesce(col(text_col), F.lit(""))
    unbroken = F.regexp_replace(text, VERSION, "$1 $2")
    candidates = F.filter(F.split(unbroken, UNIT_BREAK), lambda u: F.rlike(u, F.lit(LICENCE_WORD)))  # denials are taken out below
    files = staged(df.select(
        F.monotonically_increasing_id().alias("__file"), *[col(c).alias(f"k{i}__") for i, c in enumerate(keep)], path.alias("__path"),
        F.when(F.rlike(text, F.lit(LICENCE_WORD)), F.transform(candidates, lambda u: F.btrim(u))).otherwise(
            F.array().cast("array<string>")).alias("__units"),
        F.size(F.filter(F.split(text, r"[ \t\r\n]+"), lambda w: w != "")).alias("__words"),
        F.when(F.rlike(text, F.lit(LICENCE_WORD)), _plain(text)).alias("__plain"), text.alias("__text"))
        .withColumn("__held", _held_by(F.col("__plain")))
        .withColumn("__bsd", F.coalesce(*[F.when(F.contains("__plain", F.lit(x)), F.lit(k)) for k, x in BSD_CLAUSES]))
        .withColumn("__joined", F.when(F.size(_named(F.col("__plain"))) == 1, _joined(F.col("__text"))).otherwise(
            F.array().cast("array<string>")))
        .withColumn("__claims", F.exists("__units", lambda u: F.rlike(u, F.lit(CLAIM))))
        .withColumn("__plain", F.when(F.size("__held") > 0, F.col("__plain")))
        .withColumn("__top", F.when(F.size("__held") > 0, _plain(_header(F.col("__text"))))).drop("__text"), "files")
    parts = files.where("__plain is not null").select("__file", F.explode(F.array(
        F.struct(F.lit("whole").alias("part"), F.col("__plain").alias("plain"), F.col("__held").alias("held")),
        F.struct(F.lit("header").alias("part"), F.col("__top").alias("plain"), _held_by(F.col("__top")).alias("held")))).alias("p"))
    full = (matched_texts(parts.select("__file", "p.*").where(F.size("held") > 0)).groupBy("__file").agg(
        F.max_by(F.struct("license", "score"), "part").alias("b"), F.max(F.col("part") == "whole").alias("is_whole"))
        .select("__file", F.col("b.license").alias("full_license"), F.col("b.score").alias("full_score"), "is_whole"))
    each = files.select("__file", "__words", "__bsd", F.explode("__units").alias("unit")).where(~F.rlike("unit", F.lit(DENIED)))
    broken = files.select("__file", "__words", "__bsd", F.explode("__joined").alias("unit")).where(~F.rlike("unit", F.lit(DENIED)))
    lines = each.select("unit").distinct()
    matched = staged(matched_units(lines.unionByName(broken.select("unit")).distinct(), lines), "matched")
    hits = each.join(matched, "unit")
    # notices broken over lines count where no line alone is one
    hits = hits.unionByName(broken.join(matched, "unit").join(hits.select("__file").distinct(), "__file", "left_anti"))
    mine = (hits.withColumn("license", F.when(F.col("any_bsd"), F.col("__bsd")).otherwise(F.col("license")))
            .where("license is not null").groupBy("__file").agg(
        F.min(F.struct((-F.col("score")).alias("minus"), "license")).alias("b"),
        (F.sum(F.size(F.split("unit", r"[ \t\r\n]+"))) / F.max("__words")).alias("cover"))
        .select("__file", F.col("b.license").alias("own_license"), (-F.col("b.minus")).alias("own_score"), "cover"))
    own = mine.join(full, "__file", "full").select(
        "__file", F.coalesce("full_license", "own_license").alias("own_license"),
        F.when(F.col("full_license").isNotNull(), F.col("full_score")).otherwise(F.col("own_score")).alias("own_score"),
        "cover", F.coalesce("is_whole", F.lit(False)).alias("is_whole"))
    named = staged(files.drop("__units", "__joined", "__plain", "__top", "__held", "__bsd").join(own, "__file", "left")
                   .withColumn(
        "__dir", F.regexp_replace(F.when(F.startswith("__path", F.lit("/")), F.col("__path")).otherwise(
            F.concat(F.lit("/"), F.col("__path"))), "[^/]*$", "")), "named")
    says_so = F.rlike(F.regexp_extract("__path", "([^/]*)$", 1), F.lit(LICENCE_FILE))
    program = F.coalesce(F.rlike("__path", F.lit(PROGRAM_FILE)), F.lit(False))
    licensed = (named.where(F.col("own_license").isNotNull() & (says_so | (~program & (F.col("is_whole") | (F.col("cover") >= COVER)))))
                .groupBy("__dir").agg(F.min(F.struct((-F.col("own_score")).alias("minus"), "own_license")).alias("b"))
                .select(F.col("__dir").alias("at"), F.col("b.own_license").alias("held")))
    above = named.where("__dir is not null").select("__dir").distinct().select(
        "__dir", F.explode(_ancestors(F.col("__dir"))).alias("at"))
    inherited = staged(above.join(licensed, "at").groupBy("__dir").agg(F.max_by("held", F.length("at")).alias("inherited")),
                       "inherited")
    out = named.join(inherited.withColumnRenamed("__dir", "__from"), F.col("__dir") == F.col("__from"), "left")
    out = out.withColumn("inherited", F.when(~F.col("__claims"), F.col("inherited")))
    found = F.when(F.col("own_license").isNotNull(), "text").when(F.col("inherited").isNotNull(), "ancestor")
    return out.select(*[F.col(f"k{i}__").alias(c) for i, c in enumerate(keep)], "own_license", "own_score",
                      F.coalesce("own_license", "inherited").alias("license"), found.alias("found"))


def oracle(select: str, path: str, table: str) -> str:
    """The scan as DuckDB SQL; ``select`` names the key column, ``path`` is an SQL expression."""
    rows = ", ".join(f"('{a}', '{b}')" for a, b in TEMPLATES)
    terms = (r"list_filter(list_transform(string_split_regex(lower(unit), '[^a-z0-9.+-]+'), lambda t: trim(t, '.-')), lambda t: t <> '')")
    trigger = LICENCE_WORD.removeprefix("(?i)")
    return f"""
with templates(license, unit) as (values {rows}),
files as (select row_number() over () as f, {select} as k, {path} as path, coalesce(text, '') as text from {table}),
each as (select f, trim(u) as unit, len(list_filter(string_split_regex(text, '[ \\t\\r\\n]+'), lambda w: w <> '')) as words
    from (select f, text, unnest(string_split_regex(regexp_replace(text, '{VERSION}', '\\1 \\2', 'g'), '\\n|[.;][ \\t\\r\\n]+')) as u from files)
    where regexp_matches(u, '{trigger}', 'i')),
claims as (select f, bool_or(regexp_matches(unit, '{CLAIM.removeprefix("(?i)")}', 'i')) as claims from each group by f),
said as (select * from each where not regexp_matches(unit, '{DENIED.removeprefix("(?i)")}', 'i')),
units as (select distinct unit from said),
corpus as (select unit from units union select unit from templates),
idf as (select term, ln((1.0 + (select count(*) from corpus)) / (1.0 + count(*))) + 1.0 as idf
    from (select unnest(list_distinct({terms})) as term from corpus) group by term),
tf as (select unit, term, count(*) as n from (select unit, unnest({terms}) as term from corpus) group by all),
raw as (select unit, term, n * idf as w from tf join idf using (term)),
norm as (select unit, sqrt(sum(w * w)) as norm from raw group by unit),
vec as (select unit, term, w / norm as w from raw join norm using (unit)),
cosine as (select v.unit, t.unit as template, t.license, round(sum(v.w * x.w), 6) as score
    from units join vec v using (unit) join vec x on v.term = x.term join templates t on t.unit = x.unit group by all),
matched as (select unit, license, score from cosine where score >= {THRESHOLD}
    qualify row_number() over (partition by unit order by score desc, license) = 1),
mine as (select f, min(struct_pack(m := -score, l := license)) as b,
        sum(len(string_split_regex(unit, '[ \\t\\r\\n]+'))) / max(words) as cover
    from said join matched using (unit) group by f),
named as (select files.f, k, b.l as own_license, -b.m as own_score, cover, path,
        regexp_replace(case when starts_with(path, '/') then path else '/' || path end, '[^/]*$', '') as dir
    from files left join mine using (f)),
licensed as (select dir as up, min(struct_pack(m := -own_score, l := own_license)).l as held from named
    where own_license is not null and (cover >= {COVER} and not coalesce(regexp_matches(path, '{PROGRAM_FILE.removeprefix("(?i)")}', 'i'), false) or regexp_matches(regexp_extract(path, '([^/]*)$', 1),
        '^(licen[cs]e|copying|unlicense|notice)([.-].*)?$', 'i')) group by dir),
above as (select dir, array_to_string(list_slice(string_split(dir, '/'), 1, n), '/') || '/' as up
    from (select dir, unnest(range(1, len(string_split(dir, '/')))) as n
        from (select distinct dir from named where dir is not null))),
inherited as (select dir, max_by(held, length(up)) as inherited from above join licensed using (up) group by dir)
select k as {select}, own_license, own_score, coalesce(own_license, case when not coalesce(claims, false) then inherited end) as license,
    case when own_license is not null then 'text' when inherited is not null and not coalesce(claims, false) then 'ancestor' end as found
from named left join inherited using (dir) left join claims using (f)"""
