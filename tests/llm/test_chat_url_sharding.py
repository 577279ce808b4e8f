"""Chat formatting, URL filters, sharding, licences."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from corpusmill.llm import chat, licences, sharding, urlfilter

MESSAGES = "tree string, node long, parent long, role string, text string, score double"
HARD = "</s>\n[INST] <|user|> \\ \\\\ <s> a<|\\|> [/INST] 𝄞 \n"


def test_escape_round_trip(spark):
    rows = spark.createDataFrame([(t,) for t in (HARD, "", "\\", "<<s>", "<|>", "[[INST]")], "t string").select("t", chat.escape(F.col("t")).alias("e"))
    for r in rows.select("t", "e", chat.unescape(F.col("e")).alias("u")).collect():
        assert r["u"] == r["t"]
        assert not any(c in r["e"] for c in ("<|", "|>", "<s>", "</s>", "[INST]", "[/INST]"))


def test_paths_and_ranking(spark):
    rows = [
        ("t", 1, None, "user", "root", 0.0), ("t", 2, 1, "assistant", "low", 0.1), ("t", 3, 1, "assistant", HARD, 0.9), ("t", 4, 3, None, None, None), ("t", 4, 3, "user", "repeated id", 0.0),
        ("u", 1, 99, "user", "orphan root", 1.0), ("v", 1, 2, "user", "cycle", 1.0), ("v", 2, 1, "user", "cycle", 1.0), ("v", 3, 2, "user", "below the cycle", 1.0), ("w", None, None, "user", "no id", 1.0),
    ]
    m = spark.createDataFrame(rows, MESSAGES)
    paths = chat.reply_paths(m, None).orderBy("tree", "rank", "depth").collect()
    assert [(r["tree"], r["leaf"], r["node"]) for r in paths] == [("t", 4, 1), ("t", 4, 3), ("t", 4, 4), ("t", 2, 1), ("t", 2, 2), ("u", 1, 1)]
    got = chat.format_chats(m.withColumn("leaf", F.lit("clash"))).where("tree = 't'")
    r = got.select("n_turns", chat.read_turns(F.col("formatted")).alias("turns"), chat.under_mask(F.col("formatted"), F.col("loss_spans")).alias("loss")).first()
    assert [(t["role"], t["text"]) for t in r["turns"]] == [("user", "root"), ("assistant", HARD), ("", "")] and r["loss"] == HARD and r["n_turns"] == 3
    assert chat.format_chats(m.limit(0)).count() == 0


def test_long_chain_and_nulls(spark):
    rows = [(7, k, "user" if k % 2 == 0 else "assistant", f"t{k}") for k in range(37)] + [(None, 0, None, None), (None, 0, None, None)]
    m = chat.turns_as_messages(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    assert {r["tree"]: r["n_turns"] for r in chat.format_chats(m).collect()} == {"c7": 37, "null": 2}


def test_url_parts_rules_and_model(spark):
    cases = {
        "http://A.example.COM/en/1?q#f": ("a.example.com", "/en/1", "example.com/en/", "block"),
        "https://x.www.example.com/en/": ("x.www.example.com", "/en/", "www.example.com/en/", "allow"),
        "http://b.com/x": ("b.com", "/x", "com/", "allow"),
        "ftp://q.net/es/": ("q.net", "/es/", "net/es/", "block"),
        "http://notcom/x": ("notcom", "/x", None, None),
        "http://b.com": ("b.com", "", None, None),
        "no scheme": ("", "", None, None),
        "": ("", "", None, None),
        None: ("", "", None, None),
        "a://b\nc/d\ne?x": ("b\nc", "/d\ne", None, None),
    }
    pages = spark.createDataFrame([(k, u, "extra") for k, u in enumerate(cases)], "page_id long, url string, host string")
    model = urlfilter.fit(urlfilter.labelled_urls(spark))
    for r, (host, path, rule, verdict) in zip(urlfilter.judge_urls(pages, model).orderBy("page_id").collect(), cases.values(), strict=True):
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule)
        assert r["verdict"] == (verdict or ("block" if r["p_block"] >= 0.5 else "allow"))
    fresh = spark.createDataFrame([(1, "http://cheap-pills-now.example.org/en/5"), (2, "http://gardens.example.org/en/5")], "page_id long, url string")
    assert {r["page_id"]: r["verdict"] for r in urlfilter.judge_urls(fresh, model).collect()} == {1: "block", 2: "allow"}
    assert set(urlfilter.fit(urlfilter.labelled_urls(spark).limit(0), steps=1)[0]) == {0.0}


def brute_grams(url, sizes=(3, 4)):
    host, slash, path = url.split("://", 1)[1].partition("/")
    marked = [f"h^{host.lower()}$", f"p^{(slash + path).split('?')[0].split('#')[0]}$"]
    return [m[i : i + n] for m in marked for n in sizes for i in range(len(m) - n + 1)]


def test_url_model_equals_brute_force_and_tells_held_out_urls(spark):
    import math

    import numpy as np

    weights, bias = urlfilter.fit(urlfilter.labelled_urls(spark))
    few = [(u, 1.0) for u in urlfilter.BLOCKED_URLS] + [(u, 0.0) for u in urlfilter.ALLOWED_URLS]
    grams = sorted({g for u, _ in few for g in brute_grams(u)})
    bucket = {r["g"]: r["b"] for r in spark.createDataFrame([(g,) for g in grams], "g string").select("g", F.pmod(F.xxhash64("g"), F.lit(4096)).alias("b")).collect()}
    x = np.zeros((len(few), 4096))
    for k, (u, _) in enumerate(few):
        b = [bucket[g] for g in brute_grams(u)]
        np.add.at(x[k], b, 1 / math.sqrt(len(b)))
    y = np.array([y for _, y in few])
    w, b0 = np.zeros(4096), math.log((y.sum() + 1) / (len(y) - y.sum() + 1))
    for _ in range(24):
        p = 1 / (1 + np.exp(-(b0 + x @ w)))
        g = x.T @ (p - y) / len(y)
        w -= np.where(np.abs(x).sum(axis=0) > 0, 30.0 * (g + 1e-4 * w), 0)
    assert bias == b0 and np.abs(w - np.array(weights)).max() < 1e-6
    held = urlfilter.labelled_urls(spark, held_out=True).withColumn("page_id", F.monotonically_increasing_id())
    got = urlfilter.judge_urls(held, (weights, bias), rules=[]).join(held.select("page_id", "blocked"), "page_id").collect()
    assert sum((r["verdict"] == "block") == r["blocked"] for r in got) >= 0.9 * len(got)
    assert not {u for u in urlfilter.BLOCKED_URLS + urlfilter.ALLOWED_URLS} & {r["url"] for r in held.collect()}


# Fresh URLs: none of them, nor any of their hosts, is in the labelled table.
FRESH_BLOCKED = ["https://best-casino-slots.example.com/en/12", "http://cheap-viagra-pills.org/", "https://www.free-porn-videos.net/7", "http://m.adult-sex-cams.org/fr/3/", "https://crack-keygen-warez.info/index.html", "http://replica-rolex-watches.com/en/88", "https://instant-payday-loans.co.uk/de/5.html", "http://spam-links-farm2.org/index.html", "https://poker-jackpot-bonus.net/es/901", "http://claim-prize-iphone.com/en/1"]
FRESH_ALLOWED = ["https://www.example.com/en/110", "https://www.example.com/en/142", "http://museumofglass.org/index.html", "https://blog.riverwalks.net/fr/31/", "http://m.cityorchestra.info/19/page.html", "https://www.northernbakery.com/en/7", "https://shop.bookbinders.co.uk/de/12.html", "http://www.oldlighthouse.net/", "https://thintand.pages.org/es/640", "https://qorvexal.net/fr/55/", "http://blog.zuntrip.org/2", "https://www.mountainrescue.org/en/90", "http://weaving.example.net/es2/4", "https://chemistrynotes.com/en/3"]


def test_url_frames_cut_and_calibrated_model(spark):
    own = spark.createDataFrame([("http://a.longest-name.to/x", True), ("http://plain.uk", False), ("http://plain.uk", False), (None, False)], "url string, blocked boolean")
    got = urlfilter.framed(own, ordinary=50).collect()
    assert Counter(r["blocked"] for r in got)[True] == 1 + len(urlfilter.FRAMES)
    assert all(r["url"] is None or "{" not in r["url"] for r in got)
    names = [{r["url"] for r in urlfilter.framed(own.limit(0), ordinary=50, series=k).collect()} for k in (0, 1)]
    assert all(40 < len(x) <= 50 for x in names) and len(names[0] & names[1]) < 5

    model, cut = urlfilter.calibrated_model(spark)
    held = urlfilter.framed(urlfilter.labelled_urls(spark, held_out=True), series=1)
    told = [(r["p_block"], r["page_id"]) for r in urlfilter.judge_urls(held.select(F.col("blocked").alias("page_id"), "url"), model, rules=[]).collect()]
    hits = {c: (sum(y for p, y in told if p >= c), sum(p >= c for p, _ in told)) for c, _ in told}
    fit = [c for c, (hit, n) in hits.items() if hit >= 0.95 * n]
    most = max(hits[c][0] for c in fit)
    lowest = max(c for c in fit if hits[c][0] == most)
    want, precision, recall = urlfilter.calibrated_cut(held, model)
    assert want == cut and max([p for p, _ in told if p < lowest], default=0.0) < cut <= lowest
    assert abs(precision - hits[lowest][0] / hits[lowest][1]) < 1e-9 and abs(recall - most / sum(y for _, y in told)) < 1e-9 and recall >= 0.9
    assert urlfilter.calibrated_cut(held.limit(0), model) == (1.0, 1.0, 0.0) == urlfilter.calibrated_cut(held.where("not blocked"), model)

    fresh = spark.createDataFrame([(u, u in FRESH_BLOCKED) for u in FRESH_BLOCKED + FRESH_ALLOWED], "url string, page_id boolean")
    fresh = urlfilter.judge_urls(fresh, model, rules=[], cut=cut).collect()
    right = Counter((r["page_id"], r["verdict"]) for r in fresh)
    assert right[True, "block"] >= 9 and right[False, "block"] <= 1, right
    one = {r["path"]: r["p_block"] for r in fresh if r["host"] == "www.example.com"}
    assert abs(one["/en/110"] - one["/en/142"]) < 0.05


def test_url_odd_rows(spark):
    model = ([0.0] * 64, -1.0)
    long = "http://a.example.com/en/" + "x" * 200_000
    rows = spark.createDataFrame([(1, long, "k"), (1, long, "k"), (None, None, "k")], "page_id long, url string, host string")
    got = urlfilter.judge_urls(rows, model).collect()
    assert sorted((r["page_id"] or 0, r["host"], len(r["path"]), r["verdict"]) for r in got) == [(0, "", 0, "allow"), (1, "a.example.com", 200_004, "block"), (1, "a.example.com", 200_004, "block")]
    assert urlfilter.judge_urls(rows.limit(0), model).count() == 0


def test_chat_ties_long_texts_and_empty(spark):
    kinds = "tree string, node long, parent long, role string, text string, score double"
    rows = [("t", 1, None, "user", "q", 1.0), ("t", 3, 1, "assistant", "b", 1.0), ("t", 2, 1, "assistant", "a", 1.0), ("t", 2, 1, "assistant", "a", 1.0), ("long", 1, None, "user", "x" * 300_000, None)]
    got = {r["tree"]: r for r in chat.format_chats(spark.createDataFrame(rows, kinds).withColumns({c: F.lit("clash") for c in ("leaf", "up", "rank")})).collect()}
    assert got["t"]["leaf"] == 2 and len(got["long"]["formatted"]) > 300_000
    every = chat.format_chats(spark.createDataFrame(rows, kinds), top_k=None)
    assert {(r["tree"], r["leaf"], r["rank"]) for r in every.collect()} == {("t", 2, 1), ("t", 3, 2), ("long", 1, 1)}
    assert chat.format_chats(chat.turns_as_messages(spark.createDataFrame([], "conv_id long, turn long, role string, text string"))).count() == 0


def test_licences_ties_and_shared_ids(spark):
    both = "Released under the MIT License.\nLicensed under CC BY-NC 4.0."
    rows = spark.createDataFrame([(1, both), (1, both), (1, "Licensed under the Apache License, Version 2.0."), (None, both), (None, "All rights reserved.")], "doc_id long, text string").withColumns({c: F.lit("clash") for c in ("row", "pos", "sentence")})
    got = Counter((r["doc_id"], r["licences"]) for r in licences.scan(rows).collect())
    assert got == Counter([(1, "CC-BY-NC-4.0,MIT"), (1, "CC-BY-NC-4.0,MIT"), (1, "Apache-2.0"), (None, "CC-BY-NC-4.0,MIT"), (None, "proprietary")])
    tie = licences.scan(rows, sentences={"x": "Released under the MIT License.", "y": "Licensed under CC BY-NC 4.0."}, rules=[("first", ["x", "y"]), ("second", ["x", "y"])]).where("doc_id is null").collect()
    assert [r["licences"] for r in tie] == ["first"]


def brute_table(shards, size):
    import hashlib

    orders = []
    for s in shards:
        h = hashlib.sha256(s.encode()).digest()
        a, b = int.from_bytes(h[:8], "big") % size, int.from_bytes(h[8:16], "big") % (size - 1) + 1
        orders.append(iter([(a + b * j) % size for j in range(size)]))
    taken = {}
    while len(taken) < size:
        for k, order in enumerate(orders):
            if len(taken) < size:
                taken[next(x for x in order if x not in taken)] = k
    return [taken[x] for x in range(size)]


def test_sharding(spark):
    shards = [f"s{k}" for k in range(7)]
    table = sharding.lookup_table(shards, 251)
    assert table == brute_table(shards, 251)
    assert max(Counter(table).values()) - min(Counter(table).values()) <= 1
    big = Counter(sharding.lookup_table(sharding.SHARDS))
    assert max(big.values()) - min(big.values()) <= 1
    rows = spark.createDataFrame([(1, "a"), (1, "a"), (None, None), (2, "")], "doc_id long, shard string").withColumnRenamed("shard", "note")
    got = sharding.place(rows, "doc_id", lost=sharding.SHARDS[0]).collect()
    assert len(got) == 4 and len({r["shard"] for r in got if r["doc_id"] == 1}) == 1 and all(r["shard_without"] != sharding.SHARDS[0] for r in got)
    many = sharding.place(spark.range(20_000), "id", lost=sharding.SHARDS[0])
    moved = many.where((F.col("shard") != sharding.SHARDS[0]) & (F.col("shard") != F.col("shard_without"))).count()
    assert moved < 0.06 * 20_000
    assert sharding.place(rows.limit(0), "doc_id").count() == 0


def test_licences(spark):
    apache = [s for i, s in licences.SENTENCES.items() if i.startswith("apache")]
    mit = [licences.SENTENCES[i] for i in ("mit-title", "mit-grant", "mit-condition")]
    rows = [(1, "Prose.\n" + "\n".join(apache) + "\nMore prose"), (2, mit[0] + "\n" + " ".join(mit[1:])), (3, "RELEASED  under the *MIT* License! released under the MIT License."), (4, "A license of some kind."), (5, None), (6, ""), (7, "x " * 50_000 + "\nLicensed under CC BY-NC 4.0."), (8, licences.SENTENCES["mit-grant"])]
    got = {r["doc_id"]: r for r in licences.scan(spark.createDataFrame(rows, "doc_id long, text string").withColumn("normal", F.lit("clash"))).collect()}
    assert {k: r["licences"] for k, r in got.items()} == {1: "Apache-2.0", 2: "MIT", 3: "MIT", 7: "CC-BY-NC-4.0", 8: ""}
    assert got[3]["n_sentences"] == 2 and licences.scan(spark.createDataFrame([], "doc_id long, text string")).count() == 0


APACHE = """Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and
limitations under the License."""
MIT = """MIT License

Copyright (c) 2020 Some One

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software."""
GPL = """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version.

This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
GNU General Public License for more details."""


BSD2 = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution."""
BSD3 = BSD2 + """

3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission."""
ISC = """Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies."""
MPL = """This Source Code Form is subject to the terms of the Mozilla Public
License, v. 2.0. If a copy of the MPL was not distributed with this
file, You can obtain one at http://mozilla.org/MPL/2.0/."""


def test_licences_verbatim_headers(spark):
    """Official headers: wrapped, as comments, with carriage returns, and each paragraph in one line."""
    gpl2 = GPL.replace("software: you", "software; you").replace("version 3", "version 2")
    lgpl = GPL.replace("This program", "This library").replace("the GNU General Public License as", "the GNU Lesser General Public License as")
    heads = {"Apache-2.0": APACHE, "MIT": MIT, "GPL-3.0": GPL, "GPL-2.0": gpl2, "LGPL-3.0": lgpl, "BSD-2-Clause": BSD2, "BSD-3-Clause": BSD3, "ISC": ISC, "MPL-2.0": MPL}
    shapes = [lambda t: t, lambda t: "/*\n" + "\n".join(f" * {x}" for x in t.split("\n")) + "\n */", lambda t: "\n".join(f"# {x}".rstrip() for x in t.split("\n")), lambda t: t.replace("\n", "\r\n"), lambda t: "\n\n".join(" ".join(x.split()) for x in t.split("\n\n"))]
    rows = [(f"{name}/{k}", "Prose before.\n\n" + shape(text) + "\n\nProse after.") for name, text in heads.items() for k, shape in enumerate(shapes)]
    no = [("apart", "Licensed under\n\nCC BY-NC 4.0."), ("cut", "Licensed under. CC BY-NC 4.0."), ("longer", "Not released under the\nMIT License at all.")]
    got = {r["doc_id"]: r for r in licences.scan(spark.createDataFrame(rows + no, "doc_id string, text string")).collect()}
    assert {i: got[i]["licences"] for i, _ in rows if i in got} == {i: i.split("/")[0] for i, _ in rows}
    assert not {i for i, _ in no} & set(got)
    assert all(got[f"{name}/{k}"]["sentence_ids"] == got[f"{name}/0"]["sentence_ids"] for name in heads for k in range(len(shapes)))


def test_spdx_lines_and_rights_reserved(spark):
    tag = "SPDX-License-Identifier"
    cases = {
        f"// {tag}: MIT": "MIT", f"# {tag}: GPL-2.0-or-later": "GPL-2.0-or-later", f"{tag}: BSD-3-Clause": "BSD-3-Clause", f"/* {tag}: (MIT OR Apache-2.0) */": "Apache-2.0,MIT",
        f"{tag}: GPL-2.0-or-later WITH Classpath-exception-2.0": "GPL-2.0-or-later", f"{tag}: LGPL-2.1+ AND mit": "LGPL-2.1-or-later,MIT", f"{tag}: Nobody-1.0": None, f"text\n{tag}:Apache-2.0\nmore": "Apache-2.0",
        "Copyright 2020 X. All rights reserved.": "proprietary",
        "Copyright 2020 X. All rights reserved.\nRedistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:\n" + " ".join(licences.OFFICIAL[i][0] for i in ("bsd-source", "bsd-binary")): "BSD-2-Clause",
        "This project is licensed under the MIT license.": "MIT", "This is free and unencumbered software\nreleased into the public domain.": "Unlicense",
        "                                 Apache License\n                           Version 2.0, January 2004\n                        http://www.apache.org/licenses/\n\n   TERMS": "Apache-2.0",
        "                    GNU GENERAL PUBLIC LICENSE\n                       Version 3, 29 June 2007\n\n Copyright": "GPL-3.0",
        "Creative Commons Attribution-ShareAlike 4.0 International": "CC-BY-SA-4.0", "Distributed under the Boost Software License, Version 1.0.": "BSL-1.0",
    }
    rows = list(enumerate(cases))
    got = {r["doc_id"]: r["licences"] for r in licences.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {t: got.get(k) for k, t in rows} == cases
    with pytest.raises(ValueError, match="several identifiers"):
        licences.scan(spark.createDataFrame(rows, "doc_id long, text string"), sentences={"a": "The License", "b": "the LICENSE!"}, rules=[])
