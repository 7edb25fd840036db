import random

import duckdb
import pandas as pd
from pyspark.sql import types as T

from vitrina.llm import licenses

COLUMNS = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]


def both(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = [tuple(r) for r in licenses.scan(df).select(*COLUMNS).collect()]
    c = duckdb.connect()
    c.register("documents", pd.DataFrame(rows, columns=["doc_id", "text"]).astype({"text": object}))
    want = c.execute(licenses.oracle()).fetchall()
    return sorted(got, key=repr), sorted(want, key=repr)


def test_equals_sql_on_documents(spark, data_dir):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{data_dir}/documents.parquet").collect()]
    got, want = both(spark, rows)
    assert got == want and any(r[2] for r in got)


def test_equals_sql_on_overlapping_phrases(spark):
    rng = random.Random(3)
    every = [x for _, _, p, _, _ in licenses.rules() for x in licenses.phrases(p)]
    rows = []
    for i in range(150):
        words = []
        for _ in range(rng.randint(1, 6)):
            phrase = rng.choice(every).split()
            words += phrase[: rng.randint(1, len(phrase))] if rng.random() < 0.3 else phrase
            words += rng.choices(["the", "2", "0", "license", "version", "gnu"], k=rng.randint(0, 2))
        rows.append((i, "".join(w.upper() + rng.choice([" ", ", ", "\n- "]) if rng.random() < 0.2 else w + " " for w in words)))
    got, want = both(spark, rows)
    assert got == want


# Texts and their labels, written down from the licenses' own notices, not from the rules.
EXPECTED = [
    ("Permission is hereby granted, free of charge, to any person obtaining a copy of this software", "mit"),
    ("MIT No Attribution", "mit-0"),
    ("Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.", "apache,apache-2.0"),
    ("SPDX-License-Identifier: Apache-2.0", "apache-2.0"),
    ("SPDX-License-Identifier: GPL-2.0-only", "gpl-2.0-only"),
    ("SPDX-License-Identifier: GPL-2.0-or-later", "gpl-2.0-or-later"),
    ("SPDX-License-Identifier: LGPL-2.1-or-later", "lgpl-2.1-or-later"),
    ("SPDX-License-Identifier: BSD-3-Clause", "bsd-3-clause"),
    ("SPDX-License-Identifier: MIT", "mit"),
    ("SPDX-License-Identifier: BSL-1.0", "bsl-1.0"),
    ("GPLv3 or later", "gpl-3.0-or-later"),
    ("GNU GPL v2", "gpl-2.0-only"),
    ("under the terms of the GNU General Public License, version 3", "gpl,gpl-3.0-only"),
    ("the GNU Lesser General Public License version 2.1 or any later version", "gpl,lgpl-2.1-or-later"),
    ("GNU Library General Public License", "gpl,lgpl"),
    ("GNU Affero General Public License version 3", "agpl-3.0-only,gpl"),
    ("GNU Free Documentation License, Version 1.3", "gfdl-1.3"),
    ("Microsoft Public License (MS-PL)", "ms-pl"),
    ("Microsoft Reciprocal License", "ms-rl"),
    ("Academic Free License version 3.0", "afl-3.0"),
    ("SIL Open Font License, Version 1.1", "ofl,ofl-1.1"),
    ("Open Font License 1.1", "ofl-1.1"),
    ("Common Development and Distribution License 1.0", "cddl-1.0"),
    ("Common Public Attribution License Version 1.0", "cpal-1.0"),
    ("Common Public License 1.0", "cpl-1.0"),
    ("Open Data Commons Attribution License", "odc-by-1.0"),
    ("Open Database License 1.0", "odbl-1.0"),
    ("Eclipse Distribution License 1.0", "edl-1.0"),
    ("Eclipse Public License 2.0", "epl-2.0"),
    ("Boost Software License - Version 1.0", "bsl-1.0"),
    ("Open Software License 3.0", "osl-3.0"),
    ("Creative Commons Attribution-ShareAlike 4.0 International", "cc-by-sa-4.0"),
    ("CC BY-NC-ND 4.0", "cc-by-nc-nd-4.0"),
    ("CC0 1.0 Universal", "cc0-1.0"),
    ("Mozilla Public License, v. 2.0", "mpl-2.0"),
    ("This is free and unencumbered software released into the public domain.", "unlicense"),
    ("3-clause BSD license", "bsd-3-clause"),
    ("the new BSD license", "bsd-3-clause"),
    ("Copyright 2020 Example Ltd. All rights reserved.", "proprietary"),
    ("GPL 2.0 with Classpath exception", "classpath-exception-2.0,gpl-2.0-only"),
    ("GPLv2 with classpath exception", "classpath-exception-2.0,gpl-2.0-only"),
    ("SPDX-License-Identifier: Apache-2.0 WITH LLVM-exception", "apache-2.0,llvm-exception"),
    ("GPL-3.0 with GCC Runtime Library Exception", "gcc-exception-3.1,gpl-3.0-only"),
    ("SPDX-License-Identifier: GPL-2.0 WITH Linux-syscall-note", "gpl-2.0-only,linux-syscall-note"),
    ("SPDX-License-Identifier: GPL-2.0+", "gpl-2.0-or-later"),
    ("LGPL-2.1+", "lgpl-2.1-or-later"),
    ("GPLv3+ and AGPL-3.0+.", "agpl-3.0-or-later,gpl-3.0-or-later"),
    ("gpl 2+3 is no version", "gpl-2.0-only"),
    ("GNU GPL version 2 or 3", "gpl-2.0-or-3.0"),
    ("GNU General Public License version 2 or version 3", "gpl,gpl-2.0-or-3.0"),
    ("CPAL 1.0", "cpal-1.0"),
    ("mit 0 times", ""),
    ("SPDX-License-Identifier: MIT-0", "mit-0"),
    ("a public library and a general license to print", ""),
    ("the lesser evil", ""),
]


WARRANTY = """THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE
WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT."""
GRANT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files
(the "Software"), to deal in the Software without restriction"""
BSD = """Copyright (c) 2001, A. Person. All rights reserved.
Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice in the documentation."""
ENDORSE = "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
FEE = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted."
GNU = "This program is free software; you can redistribute it and/or modify it under the terms of the GNU {}General Public License as published by the Free Software Foundation; {}"
# Whole texts (their telling parts) of licenses that share sentences, and their labels.
WHOLE = [
    (f"Copyright (c) 2001 A. Person\n\n{GRANT}\n\n{WARRANTY}", "mit"),
    (f"MIT License\n\n{GRANT}\n{WARRANTY}", "mit"),
    (f"MIT No Attribution\n{GRANT}\n{WARRANTY}", "mit-0"),
    (f"X11 License\nCopyright (C) 1996 X Consortium\n{GRANT}\n{WARRANTY} Except as contained in this notice, the name of the X Consortium shall not be used in advertising or otherwise", "x11"),
    (f"Copyright (C) 1996 X Consortium\n{GRANT}\n{WARRANTY} Except as contained in this notice, the name of the X Consortium shall not be used in advertising", "x11"),
    (f"University of Illinois/NCSA Open Source License\nAll rights reserved.\n{GRANT}, subject to: Redistributions of source code must retain\n{WARRANTY}", "ncsa"),
    (f"This is free and unencumbered software released into the public domain.\nIn jurisdictions that recognize copyright laws, the author dedicates any interest to the public domain.\n{WARRANTY}\nFor more information, please refer to <https://unlicense.org/>", "unlicense"),
    (BSD, "bsd"),
    (f"{BSD}\n3. {ENDORSE}", "bsd,bsd-3-clause"),
    (f"{BSD}\n3. All advertising materials mentioning features or use of this software must display the following acknowledgement\n4. {ENDORSE}", "bsd-4-clause"),
    (f"BSD 2-Clause License\n{BSD}", "bsd-2-clause"),
    (f"BSD 3-Clause License\n{BSD}\n{ENDORSE}", "bsd-3-clause"),
    (f"Zero-Clause BSD\n{FEE}", "0bsd"),
    (f"Copyright 2004\n{FEE}\nTHE SOFTWARE IS PROVIDED AS IS", "isc"),
    (f"PostgreSQL License\n{FEE.replace('and/or', 'and')}", "postgresql"),
    ("This software is provided 'as-is'. 2. Altered source versions must be plainly marked as such, and must not be misrepresented.", "zlib"),
    ("libpng license. 2. Altered source versions must be plainly marked as such.", "libpng"),
    (f"Boost Software License - Version 1.0 - August 17th, 2003\n{GRANT.replace('a copy of this', 'a copy of the')}\n{WARRANTY}", "bsl-1.0"),
    ('"THE BEER-WARE LICENSE" (Revision 42): <a@b> wrote this file. If we meet some day, you can buy me a beer in return.', "beerware"),
    ("DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE Version 2, December 2004", "wtfpl"),
    (GNU.format("", "either version 2 of the License, or (at your option) any later version."), "gpl,gpl-2.0-or-later"),
    (GNU.format("Lesser ", "either version 2.1 of the License, or (at your option) any later version."), "gpl,lgpl,lgpl-2.1-or-later"),
    (GNU.format("", "version 2 only. The copyright holder designates this file as subject to the \"Classpath\" exception."), "classpath-exception-2.0,gpl"),
    ("The contents of this file are subject to the Common Development and Distribution License 1.0. You may not use this file except in compliance with the License.", "cddl-1.0"),
]


def test_whole_texts_that_share_sentences(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(WHOLE)], "doc_id long, text string")
    got = {r.doc_id: r.labels for r in licenses.scan(df).collect()}
    assert [got[i] for i in range(len(WHOLE))] == [labels for _, labels in WHOLE]
    assert both(spark, [(i, t) for i, (t, _) in enumerate([*WHOLE, *EXPECTED])])[0] == both(spark, [(i, t) for i, (t, _) in enumerate([*WHOLE, *EXPECTED])])[1]


def test_labels_of_real_notices(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(EXPECTED)], "doc_id long, text string")
    got = {r.doc_id: r.labels for r in licenses.scan(df).collect()}
    assert {t: got[i] for i, (t, _) in enumerate(EXPECTED)} == dict(EXPECTED)


def test_many_matches_in_one_text(spark):
    text = "mit license; gpl v2 or later, apache license 2.0. " * 6000
    began = __import__("time").time()
    r = licenses.scan(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert (r.n_base, r.labels) == (12000, "apache,apache-2.0,gpl-2.0-or-later,mit") and __import__("time").time() - began < 60


def test_hand_made_cases(spark):
    text = "Licensed under the Apache License, Version 2.0. MIT license; xmit license"
    rows = [(1, text), (2, None), (3, ""), (4, "..."), (5, "mit"), (6, "Mit\u00a0License"), (7, "mit license " * 300), (8, "GNU General-Public license v3"), (8, "GNU General-Public license v3")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' AS labels", "7 AS score")
    out = {r.doc_id: r for r in licenses.scan(df).collect()}
    assert (out[1].n_words, out[1].n_base, out[1].first_word, out[1].last_word) == (12, 2, 3, 8)
    assert out[1].base_labels == "apache,mit" and out[1].labels == "apache,apache-2.0,mit" and out[1].score == 1.0
    for i in (2, 3, 4):
        assert (out[i].n_words, out[i].n_base, out[i].first_word, out[i].labels, out[i].score) == (0, 0, None, "", 0.0)
    assert out[5].labels == "" and out[6].n_base == 0  # U+00A0 is part of a word
    assert (out[7].n_base, out[7].last_word, out[7].n_words) == (300, 598, 600)
    assert out[8].base_labels == "gpl" and out[8].labels == "gpl,gpl-3.0-only"
    assert licenses.scan(df).count() == len(rows) and licenses.scan(df.limit(0)).count() == 0
    assert isinstance(licenses.scan(df).schema["n_words"].dataType, T.LongType)
