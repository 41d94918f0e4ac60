"""License scans: MinHash bands over overlapping word windows retrieve templates, exact containment verifies them.

DataFrame functions only. Templates are a short fixed list, so they travel as literals.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import materialize

SHINGLE, CONTAINMENT = 5, 0.8
#: One row a band. A verified window has Jaccard at least J0 with its template (see Template.jaccard), so a band misses
#: with 1 - J0 at most and all of them with (1 - J0) ** BANDS: under 1e-7 at the worst template of the list below.
BANDS = 24
TOKEN = r"[\p{L}\p{N}]+"
#: Word parts of which each template has enough that no verified window is without one (checked when it is registered).
ANCHORS = ("licen", "permi", "granted", "copyright", "software", "redistribut", "modif")

#: Notices by which works state their licenses, headers of source files, and of bodies the whole (where short)
#: or a passage that copies hold. More of them, whole texts too, may be given to scan_licenses() as a table.
TEMPLATES = (
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("BSD-3-Clause", "Released under the BSD 3-Clause License."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that redistributions of source code must retain the above copyright notice"),
    ("BSL-1.0", "Distributed under the Boost Software License, Version 1.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-SA-4.0", "Licensed under CC BY-NC-SA 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-unversioned", "This program is free software: you can redistribute it"),
    ("LGPL-3.0", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 3 of the License, or (at your option) any later version."),
    ("AGPL-3.0", "The GNU Affero General Public License is a free, copyleft license for software and other kinds of works, specifically designed to ensure cooperation with the community in the case of network server software."),
    ("Apache-2.0", "Subject to the terms and conditions of this License, each Contributor hereby grants to You a perpetual, worldwide, non-exclusive, no-charge, royalty-free, irrevocable copyright license to reproduce, prepare Derivative Works of, publicly display, publicly perform, sublicense, and distribute the Work and such Derivative Works in Source or Object form."),
    ("BSD-3-Clause", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("BSL-1.0", "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the Software) to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so"),
    ("CC-unversioned", "By exercising the Licensed Rights (defined below), You accept and agree to be bound by the terms and conditions of this Creative Commons"),
    ("GPL-2.0", "The licenses for most software are designed to take away your freedom to share and change it. By contrast, the GNU General Public License is intended to guarantee your freedom to share and change free software"),
    ("GPL-3.0", "The GNU General Public License is a free, copyleft license for software and other kinds of works. The licenses for most software and other practical works are designed to take away your freedom to share and change the works."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("LGPL-3.0", "This version of the GNU Lesser General Public License incorporates the terms and conditions of version 3 of the GNU General Public License, supplemented by the additional permissions listed below."),
    ("MIT", "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("MPL-2.0", "Each Contributor hereby grants You a world-wide, royalty-free, non-exclusive license: (a) under intellectual property rights (other than patent or trademark) Licensable by such Contributor to use, reproduce, make available, modify, display, perform, distribute, and otherwise exploit its Contributions, either on an unmodified basis, with Modifications, or as part of a Larger Work"),
    # whole bodies
    ("0BSD", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE"),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS"),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("Unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions"),
)


def _wordings() -> dict[str, tuple[str, ...]]:
    out = {"All-rights-reserved": ("All rights reserved",)}
    for name in ("MIT", "ISC"):
        out[name] = (f"The {name} License {name}", f"{name} License Copyright")
    named = {
        "Apache-2.0": ("Apache License Version 2.0", "Apache License 2.0", "Apache 2.0 License", "Apache-2.0 License", "Apache License v2.0", "Apache Software License Version 2.0"),
        "BSD-3-Clause": ("BSD 3-Clause License", "3-Clause BSD License", "New BSD License", "Modified BSD License"),
        "BSL-1.0": ("Boost Software License Version 1.0", "Boost Software License 1.0"),
        "ISC": ("ISC License",),
        "MIT": ("MIT License", "Expat License"),
        "MPL-2.0": ("Mozilla Public License Version 2.0", "Mozilla Public License v 2.0", "Mozilla Public License 2.0"),
    }
    for name, titles in named.items():
        out[name] = (*out.get(name, ()), *(f"{by} {t}" for t in titles for by in ("under", "under the", "under the terms of the", "under the conditions of the")))
    for name, full, v in (("AGPL", "Affero General Public License", 3), ("GPL", "General Public License", 2), ("GPL", "General Public License", 3), ("LGPL", "Lesser General Public License", 3)):
        out[f"{name}-{v}.0"] = tuple(f"GNU {full} {x}" for x in (f"version {v}", f"v{v}", f"v {v}", f"{v}.0")) + tuple(f"under {the}{x}" for the in ("", "the ", "the GNU ") for x in (f"{name}v{v}", f"{name} v{v}", f"{name} {v}.0", f"{name} version {v}"))
    for parts, full in (("BY", "Attribution"), ("BY-NC", "Attribution-NonCommercial"), ("BY-NC-SA", "Attribution-NonCommercial-ShareAlike"), ("BY-SA", "Attribution-ShareAlike")):
        out[f"CC-{parts}-4.0"] = (f"CC {parts} 4.0", f"Creative Commons {full} 4.0", f"Creative Commons {parts} 4.0", f"creativecommons.org/licenses/{parts}/4.0")
    for name in sorted(out)[1:]:
        out[name] += (f"SPDX-License-Identifier: {name}",)
    return out


#: Each wording holds one of these word parts or begins with "CC BY" (checked when notices are looked for).
NOTICE_KEYS = ("licen", "reserved", "gpl", "creative")
#: Wordings found as whole word sequences, of any length: most have fewer words than a shingle.
NOTICES = _wordings()


@dataclass(frozen=True)
class Template:
    license: str
    shingles: tuple[str, ...]  # distinct
    window: int  # shingles in a window
    stride: int

    @property
    def jaccard(self) -> float:
        """The least Jaccard of a window that holds CONTAINMENT of the shingles and is otherwise foreign."""
        n = len(self.shingles)
        return CONTAINMENT * n / (self.window + (1 - CONTAINMENT) * n)


def split_words(text: str) -> list[str]:
    return re.findall(r"[^\W_]+", text.lower())


def compile_templates(texts: Iterable[tuple[str, str]] = TEMPLATES) -> list[Template]:
    """Shingles, window and stride of each (license, text); refuses one that is too short or could match without an anchor."""
    out = []
    for name, text in sorted(set(texts)):
        words = split_words(text)
        n = len(words) - SHINGLE + 1
        if n < 1:
            raise ValueError(f"template {name}: fewer than {SHINGLE} words")
        shingles = [" ".join(words[i : i + SHINGLE]) for i in range(n)]
        distinct = tuple(dict.fromkeys(shingles))
        anchored = sum(any(a in s for a in ANCHORS) for s in distinct)
        if anchored <= (1 - CONTAINMENT) * len(distinct):
            raise ValueError(f"template {name}: a window could contain {CONTAINMENT:.0%} of it without an anchor word")
        stride = max(1, n // 16)
        out.append(Template(name, distinct, n + stride - 1, stride))
    return out


def phrase_rows(notices: dict[str, tuple[str, ...]] = NOTICES) -> list[tuple[str, str, int]]:
    """(license, phrase, words) of the notices; refuses one word alone and one that the key words do not find."""
    rows = sorted({(name, " ".join(w), len(w)) for name, texts in notices.items() for w in map(split_words, texts)})
    for name, x, n in rows:
        if n < 2 or not (any(k in x for k in NOTICE_KEYS) or x.startswith("cc by")):
            raise ValueError(f"notice {name}: one word, or without a key word: {x}")
    return rows


def _pinned(df: DataFrame, name: str, value: Column) -> DataFrame:
    """``df`` with one more column, computed once a row: the optimizer would copy an expression into every lambda that uses it."""
    return df.select("*", F.explode(F.array(value)).alias(name))


def _signature(shingles: Column) -> list[Column]:
    """For each band, (least hash, its shingle)."""
    hashed = lambda band: F.transform(shingles, lambda s: F.struct(F.xxhash64(s, F.lit(band)).alias("key"), s.alias("s")))
    return [F.array_min(hashed(i)) for i in range(BANDS)]


def _windows(base: DataFrame, at: DataFrame) -> DataFrame:
    """``at`` (row, word, window, ...) with ``_ws``, the shingles of the window."""
    w = _pinned(at.join(base.select("row", "_w"), "row"), "_part", F.slice("_w", F.col("word") + 1, F.col("window") + SHINGLE - 1)).drop("_w")
    shingle = lambda i: F.array_join(F.slice("_part", i + 1, SHINGLE), " ")
    return _pinned(w, "_ws", F.transform(F.sequence(F.lit(0), F.size("_part") - SHINGLE), shingle)).drop("_part")


def scan_licenses(docs: DataFrame, templates: DataFrame | Iterable[tuple[str, str]] = TEMPLATES, notices: dict[str, tuple[str, ...]] = NOTICES) -> DataFrame:
    """(doc_id, license, containment, matched, n_words, word): licenses that documents state, over whole texts.

    A document is cut into words (letters and digits, lower case) and five-word shingles. Overlapping windows as long
    as a template are signed with BANDS minimum hashes; templates that share a band with a window (an equi-join by band
    and hash) are candidates, kept where the window contains 80 % of the template's distinct shingles. A window can only
    share a band with a template if it holds the shingle that is the template's minimum there, so only windows around
    these are made. Of overlapping windows of a template the one that contains most stays (ties: the first); it spans
    its matched words. Notices, which may be shorter than a shingle, are found word for word beside that.

    Of spans of different licenses that overlap, one that matches fewer words than another goes (then: of less
    containment, of the larger name). One row per document and license: its best containment, then most words, then the
    first place; ``matched`` words from ``word`` on.

    ``templates``: (license, text) pairs or a table of these columns, a reference list whose shingles travel to every task.
    Null or empty texts state nothing, texts under five words only notices. Rows of one doc_id are one document, and so
    are those without one. An empty table gives no rows; other columns are ignored.
    """
    spark = docs.sparkSession
    if isinstance(templates, DataFrame):
        templates = [(r["license"], r["text"]) for r in templates.where("license is not null and text is not null").select("license", "text").collect()]
    compiled, phrases = compile_templates(templates), phrase_rows(notices)
    rows = [(i, t.license, t.window, t.stride, list(t.shingles), len(t.shingles)) for i, t in enumerate(compiled)]
    refs = spark.createDataFrame(rows, "tid int, license string, window int, stride int, shingles array<string>, n int")
    bands = refs.select("tid", "window", "stride", F.posexplode(F.array(*_signature(F.col("shingles")))).alias("band", "least")).select("tid", "window", "stride", "band", "least.key", "least.s").collect()
    bands = spark.createDataFrame(bands, "tid int, window int, stride int, band int, key long, s string")  # BANDS rows a template
    least = {r["s"] for r in bands.select("s").collect()}

    text = F.lower("text")
    held = text.rlike(r"cc[^\p{L}\p{N}]+by")
    for key in (*ANCHORS, *NOTICE_KEYS):
        held = text.contains(key) | held
    words = _pinned(docs.where(F.col("text").isNotNull() & held).select("doc_id", "text"), "_w", F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))).drop("text")
    wanted = {SHINGLE: set(least)}
    for _, x, n in phrases:
        wanted.setdefault(n, set()).add(x)
    heads = {tuple(x.split()[:2]) for xs in wanted.values() for x in xs}
    among = lambda c, xs: c.isin(sorted(xs))
    joined = lambda i, n: F.array_join(F.slice("_w", i + 1, n), " ")
    head = F.filter(F.sequence(F.lit(0), F.size("_w") - 2), lambda i: among(F.get("_w", i), {a for a, _ in heads}) & among(F.get("_w", i + 1), {b for _, b in heads}))
    base = _pinned(words.where(F.size("_w") >= 2), "_at", head).where(F.size("_at") > 0)

    def of_length(n: int) -> Column:
        at = F.filter("_at", lambda i: among(joined(i, n), wanted[n]))
        return F.transform(at, lambda i: F.struct(i.alias("p"), F.lit(n).alias("n"), joined(i, n).alias("x")))

    base = _pinned(base, "_hits", F.concat(*map(of_length, sorted(wanted)))).where(F.size("_hits") > 0).select("doc_id", F.size("_w").alias("n_words"), "_w", "_hits", F.monotonically_increasing_id().alias("row"))
    base = materialize(base, "license-hits")
    hits = base.select("row", F.inline("_hits"))

    named = F.broadcast(spark.createDataFrame(phrases, "license string, x string, n int"))  # the fixed list
    spans = hits.join(named, ["x", "n"]).select("row", "license", F.lit(1.0).alias("containment"), F.col("n").alias("matched"), F.col("p").alias("word"), (F.col("p") + F.col("n")).alias("end"))

    bands = F.broadcast(bands)
    starts = hits.join(bands.select("s", "window", "stride").distinct(), F.col("x") == F.col("s"))
    first = F.ceil(F.greatest(F.col("p") - F.col("window") + 1, F.lit(0)) / F.col("stride")).cast("int")
    starts = starts.where(F.col("n") == SHINGLE).select("row", "window", "stride", F.explode(F.sequence(first, F.greatest(F.floor(F.col("p") / F.col("stride")).cast("int"), first))).alias("_k"), "p")
    starts = starts.withColumn("word", F.col("_k") * F.col("stride")).where(F.col("word") <= F.col("p")).select("row", "window", "stride", "word").distinct()
    signed = _windows(base, starts).select("row", "window", "stride", "word", F.posexplode(F.array(*[x["key"] for x in _signature(F.col("_ws"))])).alias("band", "key"))
    candidates = signed.join(bands.drop("s"), ["window", "stride", "band", "key"]).select("row", "tid", "window", "word").distinct()
    checked = _windows(base, candidates).join(F.broadcast(refs.drop("window", "stride")), "tid")  # the reference list
    checked = checked.withColumn("_m", F.size(F.array_intersect("_ws", "shingles"))).where(F.col("_m") / F.col("n") >= CONTAINMENT)
    checked = checked.select("row", "tid", "license", "window", "word", "_m", "n")
    best = F.expr("max(struct(_m, -word as first)) over (partition by row, tid order by word / window range between 0.99999 preceding and 0.99999 following)")
    checked = checked.withColumn("_best", best).where((F.col("_best._m") == F.col("_m")) & (F.col("_best.first") == -F.col("word"))).drop("_best")
    each = _windows(base, checked).select("row", "tid", "license", "word", "_m", "n", F.posexplode("_ws").alias("_i", "s"))
    each = each.join(F.broadcast(refs.select("tid", F.explode("shingles").alias("s"))), ["tid", "s"])
    spanned = each.groupBy("row", "tid", "license", "word", "_m", "n").agg(F.min("_i").alias("_a"), F.max("_i").alias("_b"))
    spanned = spanned.select("row", "license", (F.col("_m") / F.col("n")).alias("containment"), (F.col("_m") + SHINGLE - 1).alias("matched"), (F.col("word") + F.col("_a")).alias("word"), (F.col("word") + F.col("_b") + SHINGLE).alias("end"))

    spans = settle(spans.unionByName(spanned).distinct(), max((t.window for t in compiled), default=0) + SHINGLE)
    best = F.max(F.struct("containment", "matched", (-F.col("word")).alias("first"), "n_words"))
    out = spans.join(base.select("row", "doc_id", "n_words"), "row").groupBy("doc_id", "license").agg(best.alias("_b"))
    return out.select("doc_id", "license", "_b.containment", F.col("_b.matched").cast("long").alias("matched"), F.col("_b.n_words").cast("long").alias("n_words"), (-F.col("_b.first")).cast("long").alias("word"))


def settle(spans: DataFrame, cell: int) -> DataFrame:
    """Distinct ``spans`` (row, license, containment, matched, word, end) without those that a better one of another license overlaps.

    Texts are cut into cells of ``cell`` words; spans that overlap share one, so each cell is looked at alone.
    """
    cells = F.sequence(F.floor(F.col("word") / cell), F.floor((F.col("end") - 1) / cell))
    span = F.struct("license", "containment", "matched", "word", "end").alias("s")
    by_cell = spans.select("row", F.explode(cells).alias("_cell"), span).groupBy("row", "_cell").agg(F.collect_list("s").alias("_all"))
    better = lambda t, s: F.struct(t["matched"], t["containment"], s["license"]) > F.struct(s["matched"], s["containment"], t["license"])
    beaten = lambda s: F.exists("_all", lambda t: (t["license"] != s["license"]) & (t["word"] < s["end"]) & (s["word"] < t["end"]) & better(t, s))
    judged = by_cell.select("row", F.inline(F.transform("_all", lambda s: F.struct(s.alias("s"), beaten(s).alias("_lost")))))
    return judged.groupBy("row", "s").agg(F.max("_lost").alias("_lost")).where(~F.col("_lost")).select("row", "s.*")


def _values(rows: Iterable[tuple]) -> str:
    quoted = lambda v: "'" + v.replace("'", "''") + "'" if isinstance(v, str) else str(v)
    return ", ".join(f"({', '.join(map(quoted, r))})" for r in rows)


def license_sql() -> str:
    """The scan without bands: every window that holds a shingle of a template is counted."""
    compiled = compile_templates()
    t = _values((i, x.license, x.window, x.stride, len(x.shingles)) for i, x in enumerate(compiled))
    ts = _values((i, s) for i, x in enumerate(compiled) for s in x.shingles)
    return rf"""
WITH t(tid, license, win, stride, n) AS (VALUES {t}),
ts(tid, s) AS (VALUES {ts}),
ph(license, s, l) AS (VALUES {_values(phrase_rows())}),
d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}]+') AS w FROM documents WHERE text IS NOT NULL),
sh AS (SELECT r, i - 1 AS p, array_to_string(w[i:i + {SHINGLE - 1}], ' ') AS s FROM (SELECT r, w, unnest(range(1, len(w) - {SHINGLE - 2})) AS i FROM d)),
hit AS (SELECT r, tid, p, s FROM sh JOIN ts USING (s)),
starts AS (SELECT DISTINCT r, tid, win, n, license, k * stride AS a FROM (SELECT r, tid, win, n, stride, license,
  unnest(range(ceil(greatest(p - win + 1, 0) / stride)::BIGINT, floor(p / stride)::BIGINT + 1)) AS k FROM hit JOIN t USING (tid))),
wins AS (SELECT r, tid, license, win, n, a, count(DISTINCT s) AS m, min(p) AS lo, max(p) AS hi FROM starts JOIN hit USING (r, tid)
  WHERE p BETWEEN a AND a + win - 1 GROUP BY ALL HAVING count(DISTINCT s) / n >= {CONTAINMENT}::DOUBLE),
kept AS (SELECT * FROM wins x WHERE NOT EXISTS (SELECT 1 FROM wins y WHERE y.r = x.r AND y.tid = x.tid AND abs(y.a - x.a) < x.win
  AND (y.m > x.m OR (y.m = x.m AND y.a < x.a)))),
found AS (SELECT r, i - 1 AS p, l, array_to_string(w[i:i + l - 1], ' ') AS s FROM (SELECT r, w, l, unnest(range(1, len(w) - l + 2)) AS i FROM d, (SELECT DISTINCT l FROM ph))),
spans AS (SELECT DISTINCT r, license, m / n AS containment, m + {SHINGLE - 1} AS matched, lo AS word, hi + {SHINGLE} AS fin FROM kept
  UNION SELECT r, license, 1.0::DOUBLE, l, p, p + l FROM found JOIN ph USING (s, l)),
won AS (SELECT * FROM spans x WHERE NOT EXISTS (SELECT 1 FROM spans y WHERE y.r = x.r AND y.license <> x.license AND y.word < x.fin AND x.word < y.fin
  AND (y.matched > x.matched OR (y.matched = x.matched AND (y.containment > x.containment OR (y.containment = x.containment AND y.license < x.license))))))
SELECT doc_id, license, containment, matched::BIGINT AS matched, n_words::BIGINT AS n_words, word::BIGINT AS word FROM (
  SELECT doc_id, license, containment, matched, len(w) AS n_words, word, row_number() OVER (PARTITION BY doc_id, license
    ORDER BY containment DESC, matched DESC, word, len(w) DESC) AS k FROM won JOIN d USING (r)) WHERE k = 1"""
