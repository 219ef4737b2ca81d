import textwrap

import pytest

from lodestone.llm import licenses

# None of this wording is a template; wrapped, with comment marks, quoted in part or put otherwise.
HELD_OUT = {
    "AGPL-3.0": ["This file is part of Quux.\nQuux is free software: you can redistribute it and/or modify it under\nthe terms of the GNU Affero General Public License as published by the\nFree Software Foundation, either version 3 of the License, or any later\nversion.", "// SPDX-License-Identifier: AGPL-3.0"],
    "Apache-2.0": ["# Copyright 2019 The Authors. Licensed under the Apache License,\n# Version 2.0 (the License); you may not use\n# this file except in compliance with the License. You may obtain a copy there.", "This project is released under the Apache License 2.0, see LICENSE."],
    "BSD-3-Clause": [" * Redistribution and use in source and binary\n * forms, with or without modification, are\n * permitted provided that the following\n * conditions are met", "Everything here is distributed under the BSD 3-Clause License."],
    "CC-BY-4.0": ["The text of this page is available under CC BY 4.0.", "This article is licensed under a Creative Commons\nAttribution 4.0 International License, with thanks."],
    "CC-BY-NC-4.0": ["All photographs: licensed under CC BY-NC 4.0", "This video is licensed under a Creative Commons\nAttribution-NonCommercial 4.0 International License"],
    "CC-BY-SA-4.0": ["Text is available under the Creative Commons Attribution-ShareAlike 4.0 License; additional terms may apply.", "License: CC-BY-SA-4.0"],
    "CC0-1.0": ["To the extent possible under law, Jane Roe has waived all\ncopyright and related or neighboring rights to this\ndata set.", "These data are released under CC0 1.0."],
    "GPL-2.0": ["Foo is free software; you can redistribute it and/or\nmodify it under the terms of the GNU General Public License\nas published by the Free Software Foundation; either version 2\nof the License, or (at your option) any later version.", "This module is licensed under the GNU GPL v2."],
    "GPL-3.0": ["Bar is free software: you can redistribute it and/or modify\nit under the terms of the GNU General Public License as published by\nthe Free Software Foundation, either version 3 of the License, or\n(at your option) any later version.", "The program is distributed under the terms of the GNU General Public License, version 3."],
    "LGPL-3.0": ["This tool is free software; you can redistribute it and/or\nmodify it under the terms of the GNU Lesser General Public\nLicense as published by the Free Software Foundation; either\nversion 3 of the License, or (at your option) any later version.", "The library is released under the GNU Lesser General Public License, version 3."],
    "MIT": ["Permission is hereby granted, free of charge, to any person obtaining a\ncopy of this software and associated documentation files, to deal in the\nSoftware without restriction, including without limitation the rights to\nuse, copy, modify and sell copies of the Software.", "License: MIT", "This software is available under the MIT License."],
    "MPL-2.0": ["/* This Source Code Form is subject to the terms of the Mozilla\n * Public License, v. 2.0. If a copy of the MPL was not distributed\n * with this file, You can obtain one. */", "SPDX-License-Identifier: MPL-2.0"],
    "Proprietary": ["Copyright 2022 Example Ltd. All rights reserved worldwide.", "Unauthorized copying of this file,\nvia any medium, is strictly prohibited by law."],
}
CLEAN = [
    "All rights reserved by the hotel for refusing guests.", "The driver must hold a licence of class B.", "The committee granted permission to build the bridge, free of charge.", "The work of the public library is general.",
    "Version 3 of the report is out.", "Copyright law differs between countries and changes often.", "You may not use this road except on foot.", "The notice shall be shown at the door at all times.",
    "He was released under the bridge at night.", "Commons are shared by all; attribution of the fields is old.", "Software is distributed in many ways today.", "The source and the binary star were observed in many forms.",
    "Neither the name of the village nor the names of its people are known.", "The Apache people live in the south.", "MIT is a university; its licence to teach is old.", "The foundation published the terms of the prize.",
]


@pytest.fixture(scope="module")
def model(words):
    return licenses.fit([" ".join(words(n % 30 + 2, n)) for n in range(600)])


def families(model, text):
    return sorted({x[2] for x in model.scan([text])[0][0]})


def test_templates_and_variations(model):
    for family, texts in licenses.TEMPLATES.items():
        for t in texts:
            assert families(model, f"first line\n{t}\nlast") == [family], t
            for width in (40, 72):
                assert families(model, "Some words.\n\n" + textwrap.fill(t, width) + "\n\nmore") == [family], t
    one = "first line\nReleased under the MIT License.\nlast"
    assert [x[:3] for x in model.scan([one])[0][0]] == [(11, 42, "MIT")]
    assert families(model, "Copyright 2021 Jane. Released under the MIT License.") == ["MIT"]
    assert families(model, "Released under the MIT License.\nLicensed under CC BY-NC 4.0.") == ["CC-BY-NC-4.0", "MIT"]


def test_held_out_wording(model):
    """Precision and recall on wording that is in no template, alone and between lines of prose."""
    hit = wrong = total = 0
    for family, texts in HELD_OUT.items():
        for t in texts:
            for around in ("{}", "Some prose comes first here.\n\n{}\n\nAnd some after it.", "A line of prose\n{}\nand another line"):
                got = families(model, around.format(t))
                total, hit, wrong = total + 1, hit + (family in got), wrong + len([x for x in got if x != family])
    for t in CLEAN:
        wrong += len(families(model, t)) + len(families(model, textwrap.fill(t, 30)))
    print(f"recall {hit}/{total}, wrong {wrong}")
    assert hit >= 0.95 * total and wrong <= 0.02 * total


def test_unknown(model, words):
    clean = [" ".join(words(40, 9000 + n)) for n in range(200)] + [*CLEAN, "rights", "permission granted", "version 3", "", "é\n\n中文"]
    assert all(not x for x in model.scan(clean)[0])


def test_places_are_code_points(model):
    text = "élève 🙂\nAll rights reserved.\n\nAll rights reserved."
    found, n = model.scan([text, "", " \n\t\n", "a\nb\n\n\nc"])
    assert [text[a:b] for a, b, *_ in found[0]] == ["All rights reserved."] * 2
    assert n == [2, 0, 0, 2]


def test_odd_rows(spark, odd):
    docs = odd.unionByName(odd.limit(1).selectExpr("100L AS doc_id", "'x\nReleased under the MIT License.' AS text", "lang", "source", "n_chars", "score", "piece"))
    docs = docs.selectExpr("*", "1 AS k", "2 AS h", "3 AS line", "4 AS x", "5 AS found")
    rows = licenses.scan(docs, licenses.train(docs)).collect()
    assert len(rows) == docs.count()
    assert {r.doc_id: [x.family for x in r.found] for r in rows if r.found} == {100: ["MIT"]}
    empty = odd.limit(0)
    assert licenses.scan(empty, licenses.train(empty)).count() == 0
