"""Standard notices as they stand in files, licences of no family, declarations by identifier, many notices in one text."""

import time

import pytest

from slatework.llm import licences

GPL3 = """    This program is free software: you can redistribute it and/or modify
    it under the terms of the GNU General Public License as published by
    the Free Software Foundation, either version 3 of the License, or
    (at your option) any later version."""
MIT_END = """THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER"""
BSD_END = """ * THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS"
 * AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE
 * IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
 * DISCLAIMED."""
APACHE_HEAD = """                                 Apache License
                           Version 2.0, January 2004
                        http://www.apache.org/licenses/"""


@pytest.fixture(scope="module")
def model():
    return licences.train()


def families(text, model):
    return {f for _, f, *_ in licences.findings(text, model, model.bounds())}


@pytest.mark.parametrize(
    "text, want",
    [
        (GPL3, "gpl"), (GPL3.replace("GNU General", "GNU Affero General"), "agpl"), (" ".join(GPL3.split()), "gpl"), (MIT_END, "mit"), (BSD_END, "bsd"), (APACHE_HEAD, "apache"), ("MIT License\n\nCopyright (c) 2020 A", "mit"),
        ("The MIT License (MIT)", "mit"), ("Licensed under the BSD 3-Clause License", "bsd"), ("Released under the Apache License 2.0", "apache"),
        ("// SPDX-License-Identifier: MIT", "mit"), ("# SPDX-License-Identifier: Apache-2.0", "apache"), ("SPDX-License-Identifier: LGPL-2.1-or-later", "lgpl"), ("spdx-license-identifier: CC-BY-SA-4.0", "cc-by-sa"),
    ],
)
def test_standard_notices(model, text, want):
    assert families(text, model) == {want}
    assert families(f"import os\n\n{text}\n\nwords that follow", model) == {want}
    assert all(share <= 1 for *_, share in licences.findings(text, model, model.bounds()))


def test_no_family(model):
    """None of these names or wordings is in the training data."""
    for text in (
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
        "This is free software, licensed under: The Artistic License 2.0 (GPL Compatible)",
        "SPDX-License-Identifier: EPL-2.0",
    ):
        assert families(text, model) == {"unknown"}
    for text in ("The weather was fine and the general public came to see the new software in the library.", "We discussed which license to choose for the project and could not agree on any version."):
        assert families(text, model) == set()


def test_identifiers():
    assert licences.declared("/* SPDX-License-Identifier: (Apache-2.0 OR GPL-2.0-only WITH Classpath-exception-2.0) */") == ["apache", "gpl"]
    assert licences.declared("SPDX-License-Identifier: CC-BY-NC-4.0 AND Zlib") == ["cc-by-nc", "unknown"] and licences.declared("SPDX-License-Identifier:") == [] and licences.declared("MIT") == []


def test_thousands_of_notices_in_a_text(model):
    line = "Licensed under the Apache License, Version 2.0."
    began = time.perf_counter()
    found = licences.findings("\n".join([line] * 4000), model, model.bounds())
    assert [(n, f) for n, f, *_ in found] == [(i, "apache") for i in range(4000)]
    assert time.perf_counter() - began < 5
    found = licences.findings("\n".join(f"Copyright {i} Person {7 * i}. {line}" for i in range(500)), model, model.bounds())
    assert [(n, f) for n, f, *_ in found] == [(i, "apache") for i in range(500)]
