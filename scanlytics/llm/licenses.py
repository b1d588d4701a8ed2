"""License detection by ordered signature rules.

A text is reduced to its words in lower case, joined by single spaces, so a rule
is a regular expression over words. A rule is tried only where its keyword
occurs. Detections are word intervals; one that lies inside another of the same
or a higher priority is suppressed, unless both have the same priority and span
(then the first label in order stays). Built-in functions only.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .decontaminate import folded_words, word_count
from .shared import text_key

BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

# label; keyword; the name as words (regular expression); versions
FAMILIES = [
    ("gpl", "gnu", r"gnu general public licen[cs]e", ["1", "2", "3"]),
    ("lgpl", "gnu", r"gnu (?:lesser|library) general public licen[cs]e", ["2", "2.1", "3"]),
    ("agpl", "affero", r"(?:gnu )?affero general public licen[cs]e", ["1", "3"]),
    ("gfdl", "gnu", r"gnu free documentation licen[cs]e", ["1.1", "1.2", "1.3"]),
    ("apache", "apache", r"apache (?:software )?licen[cs]e", ["1.0", "1.1", "2.0"]),
    ("mit", "mit", r"mit (?:open source )?licen[cs]e", []),
    ("mit-0", "mit", r"mit no attribution(?: licen[cs]e)?", []),
    ("x11", "x11", r"x11 licen[cs]e", []),
    ("bsd-0-clause", "bsd", r"(?:zero|0) clause bsd(?: licen[cs]e)?", []),
    ("bsd-1-clause", "bsd", r"(?:1|one) clause bsd(?: licen[cs]e)?|bsd 1 clause(?: licen[cs]e)?", []),
    ("bsd-2-clause", "bsd", r"(?:2|two) clause bsd(?: licen[cs]e)?|bsd 2 clause(?: licen[cs]e)?|simplified bsd licen[cs]e", []),
    ("bsd-3-clause", "bsd", r"(?:3|three) clause bsd(?: licen[cs]e)?|bsd 3 clause(?: licen[cs]e)?|(?:new|modified) bsd licen[cs]e", []),
    ("bsd-4-clause", "bsd", r"(?:4|four) clause bsd(?: licen[cs]e)?|bsd 4 clause(?: licen[cs]e)?|original bsd licen[cs]e", []),
    ("bsd", "bsd", r"bsd (?:style )?licen[cs]e", []),
    ("isc", "isc", r"isc licen[cs]e", []),
    ("mpl", "mozilla", r"mozilla public licen[cs]e", ["1.0", "1.1", "2.0"]),
    ("epl", "eclipse", r"eclipse public licen[cs]e", ["1.0", "2.0"]),
    ("edl", "eclipse", r"eclipse distribution licen[cs]e", ["1.0"]),
    ("cddl", "distribution", r"common development and distribution licen[cs]e", ["1.0", "1.1"]),
    ("cpl", "common", r"common public licen[cs]e", ["1.0"]),
    ("eupl", "european", r"european union public licen[cs]e", ["1.0", "1.1", "1.2"]),
    ("artistic", "artistic", r"artistic licen[cs]e", ["1.0", "2.0"]),
    ("bsl", "boost", r"boost software licen[cs]e", ["1.0"]),
    ("busl", "business", r"business source licen[cs]e", ["1.1"]),
    ("sspl", "server", r"server side public licen[cs]e", ["1"]),
    ("zlib", "zlib", r"zlib(?: libpng)? licen[cs]e", []),
    ("libpng", "libpng", r"libpng licen[cs]e", ["2"]),
    ("unlicense", "unlicense", r"(?:the )?unlicense", []),
    ("wtfpl", "public licen", r"do what the \w+ you want to public licen[cs]e", ["2"]),
    ("python", "python", r"python software foundation licen[cs]e", ["2"]),
    ("php", "php", r"php licen[cs]e", ["3.0", "3.01"]),
    ("ruby", "ruby", r"ruby licen[cs]e", []),
    ("perl", "perl", r"same terms as perl itself", []),
    ("postgresql", "postgresql", r"postgresql licen[cs]e", []),
    ("openssl", "openssl", r"openssl licen[cs]e", []),
    ("curl", "curl", r"curl licen[cs]e", []),
    ("vim", "vim", r"vim licen[cs]e", []),
    ("ofl", "font", r"(?:sil )?open font licen[cs]e", ["1.0", "1.1"]),
    ("odbl", "database", r"open (?:data commons open )?database licen[cs]e", ["1.0"]),
    ("odc-by", "data", r"open data commons attribution licen[cs]e", ["1.0"]),
    ("pddl", "public domain", r"public domain dedication and licen[cs]e", ["1.0"]),
    ("cdla-permissive", "community", r"community data licen[cs]e agreement permissive", ["1.0", "2.0"]),
    ("cdla-sharing", "community", r"community data licen[cs]e agreement sharing", ["1.0"]),
    ("ms-pl", "microsoft", r"microsoft public licen[cs]e", []),
    ("ms-rl", "microsoft", r"microsoft reciprocal licen[cs]e", []),
    ("afl", "academic", r"academic free licen[cs]e", ["2.0", "2.1", "3.0"]),
    ("osl", "open", r"open software licen[cs]e", ["1.0", "2.0", "2.1", "3.0"]),
    ("ecl", "educational", r"educational community licen[cs]e", ["1.0", "2.0"]),
    ("ncsa", "ncsa", r"(?:university of illinois )?ncsa (?:open source )?licen[cs]e", []),
    ("upl", "universal", r"universal permissive licen[cs]e", ["1.0"]),
    ("lppl", "latex", r"latex project public licen[cs]e", ["1.0", "1.2", "1.3"]),
    ("qpl", "public licen", r"q public licen[cs]e", ["1.0"]),
    ("cecill", "cecill", r"cecill(?: free software)? licen[cs]e", ["1.0", "2.0", "2.1"]),
    ("mulan", "mulan", r"mulan p(?:ermissive )?s(?:oftware )?l(?:icense)?", ["1", "2"]),
    ("openrail", "rail", r"open ?rail(?: m)?(?: licen[cs]e)?", []),
    ("llama", "llama", r"llama (?:2|3) community licen[cs]e", []),
    ("cc0", "cc", r"cc0|creative commons zero", ["1.0"]),
    ("cc-by", "cc", r"cc by|creative commons attribution(?! share)(?! no)", ["1.0", "2.0", "2.5", "3.0", "4.0"]),
    ("cc-by-sa", "cc", r"cc by sa|creative commons attribution share ?alike", ["1.0", "2.0", "2.5", "3.0", "4.0"]),
    ("cc-by-nd", "cc", r"cc by nd|creative commons attribution no ?deriv(?:ative)?s", ["1.0", "2.0", "2.5", "3.0", "4.0"]),
    ("cc-by-nc", "cc", r"cc by nc|creative commons attribution non ?commercial", ["1.0", "2.0", "2.5", "3.0", "4.0"]),
    ("cc-by-nc-sa", "cc", r"cc by nc sa|creative commons attribution non ?commercial share ?alike", ["1.0", "2.0", "2.5", "3.0", "4.0"]),
    ("cc-by-nc-nd", "cc", r"cc by nc nd|creative commons attribution non ?commercial no ?deriv(?:ative)?s", ["1.0", "2.0", "2.5", "3.0", "4.0"]),
    ("public-domain", "public domain", r"(?:in|to) the public domain", []),
    ("all-rights-reserved", "rights", r"all rights reserved", []),
    ("proprietary", "proprietary", r"proprietary and confidential|confidential and proprietary", []),
]
_BEFORE = r"(?:licen[cs]ed|released|distributed|available|published|provided|covered) under (?:the )?(?:terms of (?:the )?)?"
_BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
# what a text must hold to be looked at: one of the words that every rule and base phrase needs
GATE = rf"(?i)licen[cs]e|cc0|cc{_BETWEEN}by|creative|public{_BETWEEN}domain|rights|proprietary|same{_BETWEEN}terms|spdx|mulan|rail|bsd|no{_BETWEEN}attribution|permission{_BETWEEN}(?:is|to)|redistribution{_BETWEEN}and|endorse{_BETWEEN}or|advertising{_BETWEEN}materials|altered{_BETWEEN}source|held{_BETWEEN}liable|do{_BETWEEN}what{_BETWEEN}the{_BETWEEN}fuck|a{_BETWEEN}beer|not{_BETWEEN}evil|without{_BETWEEN}warranty"


#: Written signatures of license texts: label, keyword, pattern.
BODIES = [
    ("mit", "permission is hereby granted", r"permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("mit", "permission is hereby granted", r"permission is hereby granted free of charge to any person obtaining a copy(?! of the software and accompanying)"),
    ("bsl", "permission is hereby granted", r"permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation"),
    ("bsd", "redistribution and use", r"redistribution and use in source and binary forms with or without modification are permitted(?: provided that the following conditions are met)?"),
    ("bsd-3-clause", "endorse or promote", r"neither the names? of (?:\S+ ){1,12}(?:nor the names of (?:its|their|any) (?:\S+ )?contributors )?may be used to endorse or promote products"),
    ("bsd-4-clause", "advertising materials", r"all advertising materials mentioning features or use of this software must display"),
    ("isc", "with or without fee", r"permission to use copy modify (?:and or |and )?distribute this software (?:and its documentation )?for any purpose with or without fee is hereby granted"),
    ("apache-2.0", "apache", r"licensed under the apache license version 2 0 the license you may not use this file except in compliance"),
    ("apache", "as is basis", r"unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis"),
    ("gpl", "gnu general public", r"you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("gpl-2.0", "gnu general public", r"gnu general public license as published by the free software foundation either version 2 of the license or"),
    ("gpl-3.0", "gnu general public", r"gnu general public license as published by the free software foundation either version 3 of the license or"),
    ("lgpl", "lesser general public", r"you can redistribute it and or modify it under the terms of the gnu lesser general public license"),
    ("agpl", "affero", r"you should have received a copy of the gnu affero general public license"),
    ("mpl-2.0", "mozilla", r"this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("epl", "eclipse", r"this program and the accompanying materials are made available under the terms of the eclipse public license"),
    ("zlib", "altered source", r"altered source versions must be plainly marked as such and must not be misrepresented as being the original software"),
    ("zlib", "held liable for any damages", r"in no event will the authors be held liable for any damages arising from the use of this software"),
    ("unlicense", "unencumbered", r"this is free and unencumbered software released into the public domain"),
    ("wtfpl", "do what the fuck", r"do what the fuck you want to(?: public license)?"),
    ("artistic", "artistic", r"you may distribute (?:this|it) under the (?:same )?terms of the artistic license"),
    ("ofl", "font software", r"this font software is licensed under the sil open font license"),
    ("psf", "psf hereby grants", r"psf hereby grants licensee a nonexclusive royalty free world wide license"),
    ("cc", "creative commons", r"this work is licensed under (?:a|the) creative commons"),
    ("cc0", "waived all copyright", r"has waived all copyright and related or neighboring rights"),
    ("gfdl", "free documentation", r"permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license"),
    ("beerware", "buy me a beer", r"you can buy me a beer in return"),
    ("json", "used for good", r"the software shall be used for good not evil"),
    ("no-warranty", "without warranty of any kind", r"the software is provided as is without warranty of any kind"),
]
# single words of the gate: without any of them, in lower case, a text is not matched against it
GATE_WORDS = ["licens", "licenc", "cc", "creative", "public", "rights", "proprietary", "same", "spdx", "mulan", "rail", "bsd", "attribution", "permi", "advertising", "endorse", "altered", "liable", "beer", "evil", "warranty", "redistribut", "fuck"]


def rules() -> list[tuple[int, str, str, str, int]]:
    """``order, label, keyword, pattern, priority``: titles 1, titles with a version 2, notices 3 and 4 with a version, identifiers and written signatures 5."""
    out = []
    for label, keyword, name, versions in FAMILIES:
        keys = ["creative commons", "cc"] if keyword == "cc" else [keyword]
        parts = [x for x in name.split("|") if x.startswith("creative")], [x for x in name.split("|") if not x.startswith("creative")]
        for key in keys:
            title = name if keyword != "cc" else "|".join(parts[0] if key != "cc" else parts[1])
            if not title:
                continue
            title = f"(?:{title})"
            out.append((label, key, title, 1))
            out.append((label, key, _BEFORE + title, 3))
            for v in versions:
                digits = v.replace(".", " ")
                also = f"{digits}|{digits[:-2]}(?! \\d)" if digits.endswith(" 0") else digits
                out.append((f"{label}-{v}", key, f"{title} (?:v|version )?(?:{also})", 2))
                out.append((f"{label}-{v}", key, f"{_BEFORE}{title} (?:v|version )?(?:{also})", 4))
        for v in versions or [""]:
            tag = f"{label} {v}".strip().replace("-", " ").replace(".", " ")
            out.append((f"{label}-{v}" if v else label, "spdx", f"spdx licen[cs]e identifier {tag}(?: only| or later)?", 5))
    out += [(label, key, pattern, 5) for label, key, pattern in BODIES]
    return [(i, label, key, rf"(?<= )(?:{pattern})(?= )", priority) for i, (label, key, pattern, priority) in enumerate(out)]


def _spaces(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(" ")))


def _places(text: Column, pattern: Column) -> Column:
    """Word intervals ``start, stop`` of all matches of ``pattern`` in a text of words between single spaces."""
    match, between = F.regexp_extract_all(text, pattern, F.lit(0)), F.split(text, pattern, -1)
    empty = F.expr("cast(array() as array<struct<start:int,stop:int>>)")
    pairs = F.zip_with(F.slice(between, F.lit(1), F.size(match)), match, lambda b, m: F.struct(_spaces(b).alias("b"), _spaces(m).alias("m")))
    step = lambda a, x: F.struct((a["at"] + x["b"] + x["m"]).alias("at"), F.concat(a["out"], F.array(F.struct((a["at"] + x["b"] - 1).alias("start"), (a["at"] + x["b"] + x["m"]).alias("stop")))).alias("out"))
    return F.aggregate(pairs, F.struct(F.lit(0).alias("at"), empty.alias("out")), step, lambda a: a["out"])


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: ``doc, n_words, n_base, first_word, last_word, base_labels, labels, score``, and the kept ``detections``.

    Base phrases are counted wherever their words stand consecutively; ``labels`` are theirs and
    those of the rules' kept detections, distinct, sorted, comma-joined. ``score`` is the highest
    priority kept over the highest there is. Null texts are empty; a document without a detection
    has empty labels, null places and score 0; equal rows get equal results; other columns are ignored.
    """
    base = docs.select(F.col(id_col).cast("long").alias("doc"), text_key(F.col(text_col)).alias("key"), F.col(text_col).alias("text"))
    counted = base.select("doc", "key", word_count(F.col("text")).alias("n_words"))
    low = F.lower("text")
    looked = functools.reduce(lambda a, w: a | F.contains(low, F.lit(w)), GATE_WORDS[1:], F.contains(low, F.lit(GATE_WORDS[0])))
    gated = base.where(looked & F.col("text").rlike(GATE)).select("doc", "key", F.concat(F.lit(" "), F.array_join(folded_words(F.col("text")), " "), F.lit(" ")).alias("norm"))

    def table(rows: list[tuple]) -> Column:
        return F.array(*[F.struct(F.lit(i).alias("rank"), F.lit(label).alias("label"), F.lit(key).alias("word"), F.lit(p).alias("pattern"), F.lit(n).alias("level")) for i, label, key, p, n in rows])

    phrases = table([(-1, label, phrase, f"(?<= ){phrase}(?= )", 0) for phrase, label in BASE.items()])
    both = gated.withColumn("rules", F.concat(phrases, table(rules())))
    named = F.filter("rules", lambda r: F.contains(F.col("norm"), r["word"]))
    place = lambda r: F.transform(_places(F.col("norm"), r["pattern"]), lambda p: F.struct(r["rank"].alias("rank"), r["label"].alias("label"), r["level"].alias("level"), p["start"].alias("start"), p["stop"].alias("stop")))
    # all matching is done before the first shuffle; of repeated rows one is kept
    found = both.select("doc", "key", F.flatten(F.transform(named, place)).alias("found")).groupBy("doc", "key").agg(F.first("found").alias("found"))
    found = found.select("doc", "key", F.explode("found").alias("at")).select("doc", "key", "at.*")
    # a third of the places may be one document's copies, never one document's own: its length bounds them
    places = Window.partitionBy("doc", "key").orderBy("start", F.desc("stop"), F.desc("level"), "rank").rowsBetween(Window.unboundedPreceding, -1)
    levels = range(1, 6)
    reach = {f"reach{p}": F.max(F.when(F.col("level") >= p, F.col("stop"))).over(places) for p in levels}
    marked = found.withColumns(reach)
    own = F.coalesce(*[F.when(F.col("level") == p, F.coalesce(F.col(f"reach{p}"), F.lit(-1))) for p in levels], F.lit(-1))
    marked = marked.withColumn("kept", (F.col("level") > 0) & (own < F.col("stop")))
    per = marked.groupBy("doc", "key").agg(
        F.count_if(F.col("level") == 0).alias("n_base"),
        F.min(F.when(F.col("level") == 0, F.col("start"))).cast("long").alias("first_word"),
        F.max(F.when(F.col("level") == 0, F.col("start"))).cast("long").alias("last_word"),
        F.array_sort(F.collect_set(F.when(F.col("level") == 0, F.col("label")))).alias("base"),
        F.array_sort(F.collect_set(F.when(F.col("kept") | (F.col("level") == 0), F.col("label")))).alias("all"),
        F.max(F.when(F.col("kept"), F.col("level"))).alias("top"),
        F.array_sort(F.collect_list(F.when(F.col("kept"), F.struct("start", "stop", "level", "label")))).alias("detections"),
    )
    per = per.withColumnsRenamed({"doc": "hd", "key": "hk"})
    out = counted.join(per, F.col("doc").eqNullSafe(F.col("hd")) & F.col("key").eqNullSafe(F.col("hk")), "left")
    joined = lambda c: F.coalesce(F.array_join(c, ","), F.lit(""))
    return out.select("doc", "n_words", F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"), "first_word", "last_word", joined("base").alias("base_labels"), joined("all").alias("labels"), F.coalesce(F.col("top") / 5, F.when(F.col("n_base") > 0, 0.2), F.lit(0.0)).alias("score"), "detections")
