"""License signatures against an independent plain scanner, and headers and bodies of many families."""

import re

from plenum.llm import licenses

DATA = "/root/testdata/sf0.001"

HEADERS = {
    "sspl-1.0": "Server Side Public License, version 1", "busl-1.1": "Business Source License 1.1", "elastic-2.0": "Elastic License 2.0", "postgresql": "Released under the PostgreSQL License.",
    "ncsa": "University of Illinois/NCSA Open Source License", "osl-3.0": "Open Software License v. 3.0", "afl-3.0": "Academic Free License version 3.0", "cecill-b": "license: CeCILL-B", "cecill-2.1": "CeCILL 2.1",
    "upl-1.0": "The Universal Permissive License (UPL), Version 1.0", "mulanpsl-2.0": "Mulan PSL v2", "php-3.01": "The PHP License, version 3.01", "w3c": "W3C Software Notice and License", "lppl-1.3c": "LaTeX Project Public License 1.3c",
    "ijg": "based in part: This software is based in part on the work of the Independent JPEG Group.", "apsl-2.0": "Apple Public Source License 2.0", "ms-rl": "Microsoft Reciprocal License", "qpl-1.0": "Q Public License 1.0", "sleepycat": "Sleepycat License",
    "nposl-3.0": "Non-Profit Open Software License 3.0", "rpl-1.5": "Reciprocal Public License 1.5", "ecl-2.0": "Educational Community License, Version 2.0", "ipl-1.0": "IBM Public License 1.0", "ruby": "Ruby's license", "vim": "the Vim license",
    "openssl": "OpenSSL License", "zpl-2.1": "Zope Public License 2.1", "blueoak-1.0.0": "Blue Oak Model License 1.0.0", "0bsd": "BSD Zero Clause License", "mit-0": "MIT No Attribution", "polyform-noncommercial": "PolyForm Noncommercial License 1.0.0",
    "commons-clause": "Commons Clause License Condition v1.0", "pddl-1.0": "Public Domain Dedication and License", "cc-pdm": "Public Domain Mark 1.0", "ogl-3.0": "Open Government Licence v3.0", "openrail": "CreativeML OpenRAIL-M",
    "apache-2.0": "Apache License, Version 2.0", "apache-1.1": "Apache Software License, Version 1.1", "mit": "MIT License", "isc": "ISC License", "bsd-2-clause": "BSD 2-Clause License", "bsd-3-clause": "BSD 3-Clause License", "gpl-2.0": "GPL-2.0-or-later",
    "gpl-3.0": "GNU GPL v3", "lgpl-2.1": "LGPL-2.1", "lgpl-3.0": "GNU Lesser General Public License version 3", "agpl-3.0": "AGPL-3.0", "gfdl": "GNU Free Documentation License", "mpl-2.0": "Mozilla Public License 2.0", "mpl-1.1": "MPL 1.1", "epl-2.0": "Eclipse Public License 2.0",
    "cddl-1.0": "CDDL", "cc0-1.0": "CC0 1.0 Universal", "cc-by-sa": "CC-BY-SA 4.0", "artistic-2.0": "Artistic License 2.0", "zlib": "zlib License", "bsl-1.0": "Boost Software License 1.0", "odbl-1.0": "ODbL", "ofl-1.1": "SIL Open Font License", "eupl-1.2": "EUPL 1.2",
    "json": "The Software shall be used for Good, not Evil.", "classpath-exception": "GPL with the Classpath Exception", "llvm-exception": "Apache 2.0 with LLVM Exceptions", "vim ": "There are no restrictions on distributing unmodified copies of Vim except",
    "cecill": "This software is governed by the CeCILL license under French law and abiding by the rules of distribution of free software.", "php-3.01 ": "Products derived from this software may not be called \"PHP\", nor may \"PHP\" appear in their name",
    "artistic-1.0": "The intent of this document is to state the conditions under which a Package may be copied", "unicode": "Permission is hereby granted, free of charge, to any person obtaining a copy of the Unicode data files and any associated documentation",
}


def plain(text):
    """Detections by Python's expressions without any prefilter, each held against all others."""
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").lower())
    padded, out = " " + " ".join(words) + " ", []
    for label, _, priority, _, pattern in licenses.rules():
        for m in re.finditer(f"(?<= )(?:{pattern})(?= )", padded):
            start = padded[: m.start()].count(" ") - 1
            out.append((start, start + len(m[0].split(" ")), priority, label))
    out.sort(key=lambda d: (d[0], -d[1], -d[2], d[3]))
    return [d for i, d in enumerate(out) if not any(c[2] >= d[2] and c[1] >= d[1] for c in out[:i])]


def test_headers_and_bodies_of_families(spark):
    rows = spark.createDataFrame(list(enumerate(HEADERS.values())), "doc_id long, text string")
    found = {r.doc_id: {d.label for d in r.detections} for r in licenses.scan(rows).collect()}
    assert {label: found[i] for i, label in enumerate(HEADERS) if label.strip() not in found[i]} == {}
    assert len({label.strip() for label in HEADERS}) >= 60


def test_against_a_plain_scanner(spark):
    texts = [r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").select("text").collect()] + list(HEADERS.values()) + [" and ".join(HEADERS.values()), None, ""]
    got = {r.doc_id: [(d.start, d.end, d.priority, d.label) for d in r.detections] for r in licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert all(got[i] == plain(t) for i, t in enumerate(texts)) and sum(map(len, got.values())) > 100


def test_patterns_are_distinct():
    told = [r[2] for r in (*licenses.NAMES, *licenses.BODIES)] + [r[4] for r in licenses.NOTICES]
    assert len(told) == len(set(told)) >= 190
    # Every rule's keyword stands in what the rule finds: the bodies without variable parts say so of themselves.
    plain_ones = [(told, pattern) for _, told, pattern in licenses.BODIES if not re.search(r"[\[(?]", pattern)]
    assert len(plain_ones) > 60 and all(any(k in f" {pattern} " for k in licenses.keywords(told)) for told, pattern in plain_ones)
