"""Licence paragraphs: whole wrapped notices, families the model never saw, odd tables."""

import numpy as np

from skein.llm import licences

NOTICES = {
    "mit": """Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.""",
    "bsd": """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:""",
    "isc": """Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies.""",
    "gpl-3.0": """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version.""",
    "gpl-2.0": """This program is free software; you can redistribute it and/or
modify it under the terms of the GNU General Public License
as published by the Free Software Foundation; either version 2
of the License, or (at your option) any later version.""",
    "apache-2.0": """Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.""",
}


def test_wrapped_notices_in_prose(spark):
    plain = "The river rose over night and the bridge was closed to all traffic.\nNobody knew how long it would take."
    frames = ("%s", " * %s", "// %s")
    texts = ["\n".join([plain, "", *[f % x if x else "" for x in note.split("\n")], "", plain]) for note in NOTICES.values() for f in frames]
    rows = licences.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    for i, family in enumerate(f for f in NOTICES for _ in frames):
        found = sorted((r.line, r.family) for r in rows if r.doc_id == i)
        assert {f for _, f in found} == {family} and found[0][0] == 3, (family, found)


def test_families_left_out_are_unknown():
    m = licences.model()
    strange = [
        "Licensed under the Elastic License 2.0",
        "Licensed under the EUPL, Version 1.2 or later",
        "This file may be used under the terms of the Server Side Public License, version 1",
        "Distributed under the Artistic License 2.0, see the file for details",
        "This work is made available under the Open Database License",
        "Licensed under the Business Source License 1.1; contact the vendor for other terms",
    ]
    found = [m.predict(x) for x in strange]
    assert all(f == licences.UNKNOWN and p > 0.5 for f, p, _ in found), found


def test_unknown_probability_is_calibrated_on_families_left_out():
    """Models trained without a group of families: the probability that a notice is unknown meets the share that is."""
    rng, said, so = np.random.default_rng(77), [], []
    known = licences.model().known
    for group in licences.GROUPS:
        part = licences.Softmax({**{c: ts for c, ts in licences.TEMPLATES.items() if c not in group}, licences.UNKNOWN: licences.OTHER, licences.NONE: licences.PROSE}, rng, 20, 150)
        for c, ts in licences.TEMPLATES.items():
            for t in ts:
                for _ in range(4 if c in group else 1):
                    words = licences._noised(rng, licences.tokens(t), [""])
                    facts = licences.model()._facts(part, part.logits([words])[0], words)
                    said.append(1 - 1 / (1 + np.exp(-np.array([1, *facts]) @ known)))
                    so.append(c in group)
    said, so = np.array(said), np.array(so, float)
    bins = np.minimum((said * 5).astype(int), 4)
    error = sum(abs(said[bins == b].mean() - so[bins == b].mean()) * (bins == b).mean() for b in range(5) if (bins == b).any())
    assert error < 0.1 and ((said > 0.5) == so).mean() > 0.9


def test_scores_equal_plain_counts():
    """The vectorised scores are those of the n-grams counted one by one."""
    base = licences.model().base
    texts = ["Released under the MIT License", "", "the the the of and xyzzy", "nothing zzqy here", "a copy of this software and associated documentation files"]
    many = [licences.tokens(t) for t in texts]
    for words, z in zip(many, base.logits(many)):
        at = {base.vocabulary[g] for g in licences.grams(words) if g in base.vocabulary}
        want = base.w[-1] + (sum(base.w[i] for i in at) / np.sqrt(max(1, len(at), len(words))) if at else 0)
        assert np.allclose(z, want, atol=1e-4)


def test_long_repeated_and_odd_rows(spark):
    prose = " ".join(f"Stone{i} fell down the hill into the river." for i in range(3000))
    rows = [(1, f"{prose} Released under the MIT License. {prose}", 1), (1, f"{prose} Released under the MIT License. {prose}", 1), (2, None, 2), (None, "Released under the MIT License.", 3), (4, "", 4), (5, "\n\n \n", 5), (6, "x" * 100_000, 6)]
    found = licences.scan(spark.createDataFrame(rows, "doc_id long, text string, line int")).collect()
    assert sorted(((r.doc_id, r.line, r.family) for r in found), key=repr) == [(1, 0, "mit"), (1, 0, "mit"), (None, 0, "mit")]
