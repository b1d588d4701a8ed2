import re

from scanlytics.llm import licenses


def brute(rows):
    out = []
    for d, t in rows:
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        at = [(i, label) for phrase, label in licenses.BASE.items() for i in range(len(w)) if w[i : i + len(phrase.split())] == phrase.split()]
        places = [i for i, _ in at]
        out.append((d, len(w), len(at), min(places, default=None), max(places, default=None), ",".join(sorted({x for _, x in at}))))
    return sorted(out, key=str)


def test_whole_table_and_edges(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()]
    rows += [(-1, None), (None, "cc-by"), (-2, ""), (-3, "MIT license " * 500), (-3, "MIT license " * 500), (-4, "CC BY CC.BY-NC-SA 4.0 x GNU  General, Public\nLicense v3"), (-5, "xmit license mit licensed"), (-6, "É apache LICENSE, version 2.0")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = licenses.scan_licenses(df).collect()
    assert sorted(((r.doc, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in got), key=str) == brute(rows)
    assert all(set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1 for r in got)
    by = {r.doc: r for r in got}
    assert by[-4].labels == "cc-by,cc-by-nc-sa-4.0,gpl,gpl-3"
    assert [(x.start, x.stop, x.label) for x in by[-4].detections] == [(0, 2, "cc-by"), (2, 8, "cc-by-nc-sa-4.0"), (9, 14, "gpl-3")]
    assert by[-6].labels == "apache,apache-2.0"
    assert licenses.scan_licenses(df.limit(0)).collect() == []


def test_rules_are_many_and_valid():
    made = licenses.rules()
    assert len(made) >= 250 and len({p for *_, p, _ in made}) == len(made)
    for _, _, word, pattern, _ in made:
        re.compile(pattern)
        assert word


def test_labels_against_brute_force(spark):
    """Every rule on every text, with no gate and no keyword; intervals suppressed one by one."""
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect() if re.search("(?i)licen[cs]e|cc.by|rights", r.text or "")][:60]
    said = [
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: x",
        "It is in the public_domain. same:terms as Perl itself; MIT_no:attribution", "All Rights (Reserved) and CC0 1.0", "SPDX-License-Identifier: GPL-3.0-or-later",
        "released under the terms of the GNU General Public License version 3 or the Apache License, Version 2.0", "a share of nothing at all", "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products", "PERMISSION/is", "Redistribution and use",
    ]
    rows += [(1000 + i, t) for i, t in enumerate(said)]
    made = [(re.compile(p), label, level, i) for i, label, _, p, level in licenses.rules()] + [(re.compile(f"(?<= ){p}(?= )"), label, 0, -1) for p, label in licenses.BASE.items()]
    want = {}
    for d, t in rows:
        norm = " " + " ".join(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t))) + " "
        found = sorted((norm[: m.start()].count(" ") - 1, -(norm[: m.end()].count(" ")), -level, rank, label) for p, label, level, rank in made for m in p.finditer(norm))
        labels = {label for *_, level, _, label in found if level == 0}
        for i, (_, stop, level, _, label) in enumerate(found):
            if level < 0 and not any(-s >= -stop for _, s, other, *_ in found[:i] if other <= level):
                labels.add(label)
        want[d] = ",".join(sorted(labels))
    got = {r.doc: r.labels for r in licenses.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == want
    assert got[1000] == "mit" and got[1001] == "bsd" and all(got[i] for i in range(1002, 1006))
