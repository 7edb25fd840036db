"""License scan by ordered signature rules (DataFrame functions only).

A text is reduced to its words, each between two spaces, so that a signature is a regular
expression over whole words.  Every rule has a keyword; a text is put to the rules whose
keyword it holds.  Of overlapping detections, one that lies inside another of the same or a
higher priority is suppressed.  Sentences that several licenses share (priority 1) count only in a
text that names no license, and hints (0) only where there are no such sentences either.  All of it is
expressions on the row: no shuffle.

The base phrases are a part of the rules with a priority of their own and are never
suppressed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitrina.llm.common import let, running

BASE = [("mit", "mit license"), ("apache", "apache license"), ("gpl", "general public license")]

LICENSE = "licen[cs]e"
#: Weight of a rule by its priority: 3 a notice or a name with its version, 2 a name, 1 a shared sentence, 0 a hint.
WEIGHTS = {0: 0.3, 1: 0.9, 2: 0.8, 3: 1.0}
#: Stands for a plus sign after a digit at the end of a word, as in ``GPL-2.0+``.
PLUS = "\ue000"


def version(number: str) -> str:
    """A version after a name, as words: ``version 2.0``, ``v2``, ``v 2``, ``2``."""
    first, _, rest = number.partition(".")
    ways = f"(?: version {first}| v{first}| v {first}| {first})"
    return ways + ("(?: 0)?" if rest in ("", "0") else f" {rest}")


def plus(number: str) -> str:
    """A version with a plus sign."""
    return version(number) + PLUS


LATER = "(?: or later| or any later version| or at your option any later version)"

#: The signature rules in order: label, keyword (a word of every match), words as a pattern, priority.
SIGNATURES = [
    # MIT and relatives
    ("mit", "mit", f"(?:the )?mit {LICENSE}", 2),
    ("mit", "mit", f"mit(?: x11| expat) {LICENSE}", 2),
    ("mit", "expat", f"expat {LICENSE}", 2),
    ("mit", "mit", f"licensed under (?:the )?mit(?: {LICENSE})?", 3),
    ("mit", "mit", f"{LICENSE} mit", 2),
    ("mit", "permission", "permission is hereby granted free of charge to any person obtaining a copy", 1),
    ("mit", "noninfringement", "warranties of merchantability fitness for a particular purpose and noninfringement", 1),
    ("mit-0", "mit", f"mit no attribution(?: {LICENSE})?", 3),
    ("mit-0", "mit", f"(?:identifier|the) mit 0(?: {LICENSE})?", 3),
    ("mit-0", "mit", f"mit 0 {LICENSE}", 3),
    ("x11", "x11", f"x11 {LICENSE}", 2),
    ("x11", "consortium", f"x consortium {LICENSE}", 2),
    ("x11", "consortium", "the name of the x consortium shall not be used in advertising", 3),
    # Apache
    ("apache", "apache", f"apache(?: software| public)? {LICENSE}", 2),
    ("apache-1.0", "apache", f"apache(?: software)? {LICENSE}(?: version| v)? 1 0", 3),
    ("apache-1.1", "apache", f"apache(?: software)? {LICENSE}(?: version| v)? 1 1", 3),
    ("apache-2.0", "apache", f"apache(?: software)? {LICENSE}{version('2')}", 3),
    ("apache-2.0", "apache", "apache 2(?: 0)?", 3),
    ("apache-2.0", "apache", f"licensed under the apache {LICENSE}{version('2')}", 3),
    ("apache-2.0", "asl", "(?:apache )?asl(?: v2| 2)(?: 0)?", 3),
    ("apache-2.0", "compliance", "you may not use this file except in compliance with the license", 1),
    # GNU general public license
    ("gpl", "gpl", "(?:gnu )?gpl", 2),
    ("gpl", "general", f"gnu general public {LICENSE}", 2),
    ("gpl-1.0-only", "gpl", f"(?:gnu )?gpl{version('1')}(?: only)?", 3),
    ("gpl-1.0-or-later", "gpl", f"(?:gnu )?gpl{version('1')}{LATER}", 3),
    ("gpl-1.0-only", "general", f"(?:gnu )?general public {LICENSE}{version('1')}", 3),
    ("gpl-1.0-or-later", "general", f"(?:gnu )?general public {LICENSE}{version('1')}{LATER}", 3),
    ("gpl-2.0-only", "gpl", f"(?:gnu )?gpl{version('2')}(?: only)?", 3),
    ("gpl-2.0-or-later", "gpl", f"(?:gnu )?gpl{version('2')}{LATER}", 3),
    ("gpl-2.0-only", "gplv2", "gplv2(?: only)?", 3),
    ("gpl-2.0-or-later", "gplv2", f"gplv2{LATER}", 3),
    ("gpl-2.0-only", "general", f"(?:gnu )?general public {LICENSE}{version('2')}(?: only)?", 3),
    ("gpl-2.0-or-later", "general", f"(?:gnu )?general public {LICENSE}{version('2')}{LATER}", 3),
    ("gpl-2.0-or-later", "option", f"either version 2 of the {LICENSE} or at your option any later version", 3),
    *(
        (f"{name}-{v}.0-or-later", keyword, f"(?:gnu )?{words}{plus(v)}", 3)
        for name, keyword, words, versions in (
            ("gpl", "gpl", "gpl", "123"), ("gpl", "general", f"general public {LICENSE}", "123"), ("lgpl", "lgpl", "lgpl", "23"), ("agpl", "agpl", "agpl", "3"),
        )
        for v in versions
    ),
    ("lgpl-2.1-or-later", "lgpl", f"(?:gnu )?lgpl{plus('2.1')}", 3),
    ("lgpl-2.1-or-later", "lgplv2", f"lgplv2 1{PLUS}", 3),
    *((f"{name}-{v}.0-or-later", f"{name}v{v}{PLUS}", f"{name}v{v}{PLUS}", 3) for name, v in (("gpl", 2), ("gpl", 3), ("lgpl", 2), ("lgpl", 3), ("agpl", 3))),
    ("gpl-2.0-or-3.0", "gpl", f"(?:gnu )?gpl{version('2')} or{version('3')}", 3),
    ("gpl-2.0-or-3.0", "gpl", "(?:gnu )?gpl versions? 2(?: 0)? or 3(?: 0)?", 3),
    ("gpl-2.0-or-3.0", "general", f"(?:gnu )?general public {LICENSE}{version('2')} or{version('3')}", 3),
    # Exceptions
    ("classpath-exception-2.0", "classpath", "classpath exception", 3),
    ("gcc-exception-3.1", "gcc", "gcc runtime library exception", 3),
    ("llvm-exception", "llvm", "llvm exceptions?", 3),
    ("autoconf-exception", "autoconf", "autoconf exception", 3),
    ("bison-exception-2.2", "bison", "bison exception", 3),
    ("font-exception-2.0", "font", "font exception", 3),
    ("linux-syscall-note", "syscall", "linux syscall note", 3),
    ("linking-exception", "linking", "(?:static |independent modules )?linking exception", 3),
    ("gpl-3.0-only", "gpl", f"(?:gnu )?gpl{version('3')}(?: only)?", 3),
    ("gpl-3.0-or-later", "gpl", f"(?:gnu )?gpl{version('3')}{LATER}", 3),
    ("gpl-3.0-only", "gplv3", "gplv3(?: only)?", 3),
    ("gpl-3.0-or-later", "gplv3", f"gplv3{LATER}", 3),
    ("gpl-3.0-only", "general", f"(?:gnu )?general public {LICENSE}{version('3')}(?: only)?", 3),
    ("gpl-3.0-or-later", "general", f"(?:gnu )?general public {LICENSE}{version('3')}{LATER}", 3),
    ("gpl-3.0-or-later", "option", f"either version 3 of the {LICENSE} or at your option any later version", 3),
    ("gpl", "redistribute", f"you can redistribute it and or modify it under the terms of the gnu general public {LICENSE}", 3),
    # GNU lesser, library, affero, documentation
    ("lgpl", "lgpl", "(?:gnu )?lgpl", 2),
    ("lgpl", "lesser", f"(?:gnu )?lesser general public {LICENSE}", 3),
    ("lgpl", "library", f"(?:gnu )?library general public {LICENSE}", 3),
    ("lgpl-2.0-only", "lgpl", f"(?:gnu )?lgpl{version('2')}(?: only)?", 3),
    ("lgpl-2.0-or-later", "lgpl", f"(?:gnu )?lgpl{version('2')}{LATER}", 3),
    ("lgpl-2.0-only", "library", f"(?:gnu )?library general public {LICENSE}{version('2')}", 3),
    ("lgpl-2.0-or-later", "library", f"(?:gnu )?library general public {LICENSE}{version('2')}{LATER}", 3),
    ("lgpl-2.1-only", "lgpl", f"(?:gnu )?lgpl{version('2.1')}(?: only)?", 3),
    ("lgpl-2.1-or-later", "lgpl", f"(?:gnu )?lgpl{version('2.1')}{LATER}", 3),
    ("lgpl-2.1-only", "lgplv2", "lgplv2 1(?: only)?", 3),
    ("lgpl-2.1-or-later", "lgplv2", f"lgplv2 1{LATER}", 3),
    ("lgpl-2.1-only", "lesser", f"(?:gnu )?lesser general public {LICENSE}{version('2.1')}(?: only)?", 3),
    ("lgpl-2.1-or-later", "lesser", f"(?:gnu )?lesser general public {LICENSE}{version('2.1')}{LATER}", 3),
    ("lgpl-2.1-or-later", "option", f"either version 2 1 of the {LICENSE} or at your option any later version", 3),
    ("lgpl-3.0-only", "lgpl", f"(?:gnu )?lgpl{version('3')}(?: only)?", 3),
    ("lgpl-3.0-or-later", "lgpl", f"(?:gnu )?lgpl{version('3')}{LATER}", 3),
    ("lgpl-3.0-only", "lgplv3", "lgplv3(?: only)?", 3),
    ("lgpl-3.0-or-later", "lgplv3", f"lgplv3{LATER}", 3),
    ("lgpl-3.0-only", "lesser", f"(?:gnu )?lesser general public {LICENSE}{version('3')}(?: only)?", 3),
    ("lgpl-3.0-or-later", "lesser", f"(?:gnu )?lesser general public {LICENSE}{version('3')}{LATER}", 3),
    ("lgpl", "redistribute", f"you can redistribute it and or modify it under the terms of the gnu lesser general public {LICENSE}", 3),
    ("agpl", "agpl", "(?:gnu )?agpl", 2),
    ("agpl", "affero", f"(?:gnu )?affero general public {LICENSE}", 3),
    ("agpl-1.0", "affero", f"(?:gnu )?affero general public {LICENSE}{version('1')}", 3),
    ("agpl-3.0-only", "agpl", f"(?:gnu )?agpl{version('3')}(?: only)?", 3),
    ("agpl-3.0-or-later", "agpl", f"(?:gnu )?agpl{version('3')}{LATER}", 3),
    ("agpl-3.0-only", "agplv3", "agplv3(?: only)?", 3),
    ("agpl-3.0-or-later", "agplv3", f"agplv3{LATER}", 3),
    ("agpl-3.0-only", "affero", f"(?:gnu )?affero general public {LICENSE}{version('3')}(?: only)?", 3),
    ("agpl-3.0-or-later", "affero", f"(?:gnu )?affero general public {LICENSE}{version('3')}{LATER}", 3),
    ("gfdl", "documentation", f"(?:gnu )?free documentation {LICENSE}", 2),
    ("gfdl", "gfdl", "gfdl", 2),
    ("gfdl-1.1", "documentation", f"(?:gnu )?free documentation {LICENSE} version 1 1", 3),
    ("gfdl-1.2", "documentation", f"(?:gnu )?free documentation {LICENSE} version 1 2", 3),
    ("gfdl-1.3", "documentation", f"(?:gnu )?free documentation {LICENSE} version 1 3", 3),
    ("gfdl-1.2", "gfdl", "gfdl 1 2(?: only| or later)?", 3),
    ("gfdl-1.3", "gfdl", "gfdl 1 3(?: only| or later)?", 3),
    # BSD and relatives
    ("bsd", "bsd", f"(?:a )?bsd(?: style)? {LICENSE}", 2),
    ("0bsd", "0bsd", "0bsd", 3),
    ("0bsd", "bsd", f"(?:zero clause bsd|bsd zero clause)(?: {LICENSE})?", 3),
    ("bsd-1-clause", "bsd", f"(?:1 clause bsd|bsd 1 clause)(?: {LICENSE})?", 3),
    ("bsd-2-clause", "bsd", f"(?:2 clause bsd|bsd 2 clause|two clause bsd)(?: {LICENSE})?", 3),
    ("bsd-2-clause", "bsd", f"(?:simplified|free) bsd {LICENSE}", 3),
    ("bsd-2-clause", "freebsd", f"freebsd {LICENSE}", 3),
    ("bsd-3-clause", "bsd", f"(?:3 clause bsd|bsd 3 clause|three clause bsd)(?: {LICENSE})?", 3),
    ("bsd-3-clause", "bsd", f"(?:new|modified|revised) bsd {LICENSE}", 3),
    ("bsd-3-clause-clear", "bsd", f"(?:clear bsd|bsd 3 clause clear)(?: {LICENSE})?", 3),
    ("bsd-4-clause", "bsd", f"(?:4 clause bsd|bsd 4 clause|four clause bsd)(?: {LICENSE})?", 3),
    ("bsd-4-clause", "bsd", f"(?:original|old) bsd {LICENSE}", 3),
    ("bsd", "redistribution", "redistribution and use in source and binary forms with or without modification", 1),
    ("bsd-3-clause", "endorse", "may be used to endorse or promote products derived from this software without specific prior written permission", 1),
    ("bsd-4-clause", "advertising", "all advertising materials mentioning features or use of this software must display the following acknowledgement", 3),
    ("isc", "isc", f"isc {LICENSE}", 2),
    ("isc", "permission", "permission to use copy modify and(?: or)? distribute this software for any purpose with or without fee is hereby granted", 1),
    ("ncsa", "ncsa", f"(?:university of illinois )?ncsa(?: open source)? {LICENSE}", 3),
    ("hpnd", "historical", "historical permission notice and disclaimer", 3),
    ("zlib", "zlib", f"zlib {LICENSE}", 2),
    ("zlib", "altered", "altered source versions must be plainly marked as such", 1),
    ("libpng", "libpng", f"libpng {LICENSE}", 2),
    ("zlib", "zlib", f"zlib libpng {LICENSE}", 3),
    ("bsl-1.0", "boost", f"boost software {LICENSE}", 2),
    ("bsl-1.0", "boost", f"boost software {LICENSE}(?: version)? 1 0", 3),
    ("bsl-1.0", "bsl", "bsl 1 0", 3),
    ("curl", "curl", f"curl {LICENSE}", 2),
    ("vim", "vim", f"vim {LICENSE}", 2),
    ("tcl", "tcl", f"tcl(?: tk)? {LICENSE}", 2),
    ("icu", "icu", f"icu {LICENSE}", 2),
    ("ijg", "jpeg", "work of the independent jpeg group", 3),
    ("ftl", "freetype", f"freetype(?: project)? {LICENSE}", 3),
    ("info-zip", "zip", f"info zip {LICENSE}", 3),
    ("bzip2", "bzip2", f"bzip2 {LICENSE}", 3),
    ("xnet", "xnet", f"xnet {LICENSE}", 3),
    ("beerware", "beer", "the beer ware license", 3),
    ("beerware", "beer", "you can buy me a beer in return", 3),
    ("json", "evil", "the software shall be used for good not evil", 3),
    ("blueoak-1.0.0", "oak", f"blue oak model {LICENSE}", 3),
    ("upl-1.0", "universal", f"universal permissive {LICENSE}", 3),
    ("afl", "academic", f"academic free {LICENSE}", 2),
    ("afl-1.2", "academic", f"academic free {LICENSE}(?: version| v)? 1 2", 3),
    ("afl-2.0", "academic", f"academic free {LICENSE}(?: version| v)? 2 0", 3),
    ("afl-2.1", "academic", f"academic free {LICENSE}(?: version| v)? 2 1", 3),
    ("afl-3.0", "academic", f"academic free {LICENSE}(?: version| v)? 3 0", 3),
    ("ecl-2.0", "educational", f"educational community {LICENSE}{version('2')}", 3),
    ("ecl-1.0", "educational", f"educational community {LICENSE}{version('1')}", 3),
    ("mulanpsl-2.0", "mulan", f"mulan permissive software {LICENSE}(?: version| v)? 2", 3),
    # Weak copyleft
    ("mpl", "mozilla", f"mozilla public {LICENSE}", 2),
    ("mpl", "mpl", "mpl", 2),
    ("mpl-1.0", "mozilla", f"mozilla public {LICENSE}(?: version| v)? 1 0", 3),
    ("mpl-1.1", "mozilla", f"mozilla public {LICENSE}(?: version| v)? 1 1", 3),
    ("mpl-2.0", "mozilla", f"mozilla public {LICENSE}{version('2')}", 3),
    ("mpl-1.1", "mpl", "mpl(?: version| v)? 1 1", 3),
    ("mpl-2.0", "mpl", f"mpl{version('2')}", 3),
    ("mpl-2.0", "mozilla", f"this source code form is subject to the terms of the mozilla public {LICENSE}", 3),
    ("npl-1.1", "netscape", f"netscape public {LICENSE}(?: version| v)? 1 1", 3),
    ("epl", "eclipse", f"eclipse public {LICENSE}", 2),
    ("epl-1.0", "eclipse", f"eclipse public {LICENSE}{version('1')}", 3),
    ("epl-2.0", "eclipse", f"eclipse public {LICENSE}{version('2')}", 3),
    ("epl-1.0", "epl", "epl 1 0", 3),
    ("epl-2.0", "epl", "epl 2 0", 3),
    ("edl-1.0", "eclipse", f"eclipse distribution {LICENSE}(?: version| v)?(?: 1 0)?", 3),
    ("cpl-1.0", "common", f"common public {LICENSE}(?: version| v)? 1 0", 3),
    ("cpl", "common", f"common public {LICENSE}", 2),
    ("cddl", "distribution", f"common development and distribution {LICENSE}", 2),
    ("cddl-1.0", "distribution", f"common development and distribution {LICENSE}(?: version| v)? 1 0", 3),
    ("cddl-1.1", "distribution", f"common development and distribution {LICENSE}(?: version| v)? 1 1", 3),
    ("cddl", "cddl", "cddl", 2),
    ("cddl-1.0", "cddl", "cddl 1 0", 3),
    ("cddl-1.1", "cddl", "cddl 1 1", 3),
    ("cpal-1.0", "attribution", f"common public attribution {LICENSE}(?: version| v)?(?: 1 0)?", 3),
    ("cpal-1.0", "cpal", "cpal(?: version| v)?(?: 1 0)?", 3),
    ("ipl-1.0", "ibm", f"ibm public {LICENSE}(?: version| v)?(?: 1 0)?", 3),
    ("spl-1.0", "sun", f"sun public {LICENSE}(?: version| v)?(?: 1 0)?", 3),
    ("sissl", "sun", f"sun industry standards source {LICENSE}", 3),
    ("apsl-2.0", "apple", f"apple public source {LICENSE}(?: version| v)?(?: 2 0)?", 3),
    ("ms-pl", "microsoft", f"microsoft public {LICENSE}", 3),
    ("ms-pl", "ms", "ms pl", 3),
    ("ms-rl", "microsoft", f"microsoft reciprocal {LICENSE}", 3),
    ("ms-rl", "ms", "ms rl", 3),
    ("artistic", "artistic", f"artistic {LICENSE}", 2),
    ("artistic-1.0", "artistic", f"artistic {LICENSE}(?: version| v)? 1 0", 3),
    ("artistic-2.0", "artistic", f"artistic {LICENSE}{version('2')}", 3),
    ("artistic-1.0-perl", "perl", f"perl artistic {LICENSE}", 3),
    ("clartistic", "clarified", f"clarified artistic {LICENSE}", 3),
    ("qpl-1.0", "public", f"q public {LICENSE}(?: version| v)?(?: 1 0)?", 3),
    ("lppl", "latex", f"latex project public {LICENSE}", 2),
    ("lppl-1.3c", "latex", f"latex project public {LICENSE}(?: version| v)? 1 3c?", 3),
    ("zpl-2.1", "zope", f"zope public {LICENSE}(?: version| v)? 2 1", 3),
    ("zpl", "zope", f"zope public {LICENSE}", 2),
    # Strong copyleft and source available
    ("eupl", "european", f"european union public {LICENSE}", 2),
    ("eupl", "eupl", "eupl", 2),
    ("eupl-1.1", "eupl", "eupl(?: version| v)? 1 1", 3),
    ("eupl-1.2", "eupl", "eupl(?: version| v)? 1 2", 3),
    ("eupl-1.1", "european", f"european union public {LICENSE}(?: version| v)? 1 1", 3),
    ("eupl-1.2", "european", f"european union public {LICENSE}(?: version| v)? 1 2", 3),
    ("osl", "open", f"open software {LICENSE}", 2),
    ("osl-2.1", "open", f"open software {LICENSE}(?: version| v)? 2 1", 3),
    ("osl-3.0", "open", f"open software {LICENSE}(?: version| v)? 3 0", 3),
    ("rpl-1.5", "reciprocal", f"reciprocal public {LICENSE}(?: version)? 1 5", 3),
    ("sleepycat", "sleepycat", f"sleepycat {LICENSE}", 3),
    ("cecill", "cecill", "cecill(?: free software licen[cs]e)?", 2),
    ("cecill-2.1", "cecill", "cecill(?: version| v)? 2 1", 3),
    ("cecill-b", "cecill", "cecill b", 3),
    ("cecill-c", "cecill", "cecill c", 3),
    ("sspl-1.0", "server", f"server side public {LICENSE}", 3),
    ("sspl-1.0", "sspl", "sspl", 3),
    ("elastic-2.0", "elastic", f"elastic {LICENSE}{version('2')}", 3),
    ("busl-1.1", "business", f"business source {LICENSE}(?: version)?(?: 1 1)?", 3),
    ("commons-clause", "clause", f"commons clause(?: {LICENSE})?(?: condition)?", 3),
    ("polyform-noncommercial", "polyform", f"polyform noncommercial {LICENSE}", 3),
    # Languages and projects
    ("psf-2.0", "python", f"python software foundation {LICENSE}(?: version 2)?", 3),
    ("python-2.0", "python", f"python {LICENSE}(?: 2 0)?", 2),
    ("php", "php", f"php {LICENSE}", 2),
    ("php-3.0", "php", f"php {LICENSE}(?: version)? 3 0", 3),
    ("php-3.01", "php", f"php {LICENSE}(?: version)? 3 01", 3),
    ("ruby", "ruby", f"ruby(?: s)? {LICENSE}", 2),
    ("postgresql", "postgresql", f"postgresql {LICENSE}", 2),
    ("openssl", "openssl", f"openssl {LICENSE}", 2),
    ("openssl", "openssl", "includes software developed by the openssl project", 3),
    ("ssleay", "ssleay", f"(?:original )?ssleay {LICENSE}", 3),
    ("w3c", "w3c", f"w3c software(?: notice and)? {LICENSE}", 3),
    ("unicode-dfs-2016", "unicode", "unicode inc license agreement data files and software", 3),
    ("ofl", "font", f"(?:sil )?open font {LICENSE}", 2),
    ("ofl-1.0", "font", f"open font {LICENSE}(?: version| v)? 1 0", 3),
    ("ofl-1.1", "font", f"open font {LICENSE}(?: version| v)? 1 1", 3),
    ("nasa-1.3", "nasa", "nasa open source agreement(?: version| v)? 1 3", 3),
    ("nvidia", "nvidia", f"nvidia(?: software)? {LICENSE} agreement", 3),
    ("intel", "intel", f"intel open source {LICENSE}", 3),
    # Data
    ("odbl", "database", f"open(?: data commons open)? database {LICENSE}", 2),
    ("odbl-1.0", "database", f"open database {LICENSE}(?: version| v)? 1 0", 3),
    ("odbl", "odbl", "odbl", 2),
    ("odc-by-1.0", "commons", f"open data commons attribution {LICENSE}", 3),
    ("pddl-1.0", "dedication", "public domain dedication and licen[cs]e", 3),
    ("cdla-permissive", "community", f"community data {LICENSE} agreement permissive", 3),
    # Public domain
    ("public-domain", "domain", "(?:released into|dedicated to|placed in|in) the public domain", 3),
    ("cc0-1.0", "cc0", "cc0(?: 1 0)?(?: universal)?", 3),
    ("cc0-1.0", "zero", "creative commons zero(?: v1 0| 1 0)?(?: universal)?", 3),
    ("unlicense", "unlicense", "(?:the )?unlicense", 2),
    ("unlicense", "unencumbered", "free and unencumbered software released into the public domain", 3),
    ("wtfpl", "wtfpl", "wtfpl", 3),
    ("wtfpl", "want", f"do what the fuck you want to public {LICENSE}", 3),
    # Proprietary
    ("proprietary", "proprietary", f"proprietary {LICENSE}", 2),
    ("proprietary", "confidential", "(?:proprietary and confidential|confidential and proprietary)", 3),
    ("proprietary", "unauthorized", "unauthorized copying of this file via any medium is strictly prohibited", 3),
    ("proprietary", "eula", "(?:end user licen[cs]e agreement )?eula", 2),
    ("proprietary", "user", "end user licen[cs]e agreement", 2),
    ("proprietary", "rights", "all rights reserved", 0),
    # SPDX tags that no name above covers
    ("mit", "spdx", "spdx license identifier mit", 3),
    ("mit-0", "spdx", "spdx license identifier mit 0", 3),
    ("isc", "spdx", "spdx license identifier isc", 3),
    ("zlib", "spdx", "spdx license identifier zlib", 3),
    ("curl", "spdx", "spdx license identifier curl", 3),
    ("ncsa", "spdx", "spdx license identifier ncsa", 3),
    ("vim", "spdx", "spdx license identifier vim", 3),
    # Creative Commons
    ("cc", "commons", f"creative commons {LICENSE}", 2),
    ("cc-by", "commons", f"creative commons attribution(?: {LICENSE})?", 2),
    ("cc-by-sa", "commons", "creative commons attribution share ?alike", 2),
    ("cc-by-nd", "commons", "creative commons attribution no ?deriv(?:ative|atives|s)", 2),
    ("cc-by-nc", "commons", "creative commons attribution non ?commercial", 2),
    ("cc-by-nc-sa", "commons", "creative commons attribution non ?commercial share ?alike", 2),
    ("cc-by-nc-nd", "commons", "creative commons attribution non ?commercial no ?deriv(?:ative|atives|s)", 2),
    ("cc-by", "cc", "cc by", 2),
    ("cc-by-sa", "cc", "cc by sa", 2),
    ("cc-by-nd", "cc", "cc by nd", 2),
    ("cc-by-nc", "cc", "cc by nc", 2),
    ("cc-by-nc-sa", "cc", "cc by nc sa", 2),
    ("cc-by-nc-nd", "cc", "cc by nc nd", 2),
    *(
        (f"cc-{code}-{v}", keyword, f"{words}(?: international| unported)?(?: {LICENSE})? {v.replace('.', ' ')}(?: international| unported)?" if keyword == "commons" else f"{words} {v.replace('.', ' ')}", 3)
        for v in ("1.0", "2.0", "2.5", "3.0", "4.0")
        for code, keyword, words in (
            ("by", "cc", "cc by"), ("by", "commons", "creative commons attribution"), ("by-sa", "cc", "cc by sa"), ("by-sa", "commons", "creative commons attribution share ?alike"),
            ("by-nd", "cc", "cc by nd"), ("by-nd", "commons", "creative commons attribution no ?derivatives"), ("by-nc", "cc", "cc by nc"), ("by-nc", "commons", "creative commons attribution non ?commercial"),
            ("by-nc-sa", "cc", "cc by nc sa"), ("by-nc-sa", "commons", "creative commons attribution non ?commercial share ?alike"),
            ("by-nc-nd", "cc", "cc by nc nd"), ("by-nc-nd", "commons", "creative commons attribution non ?commercial no ?derivatives"),
        )
    ),
]


def rules() -> list[tuple[str, str, str, int, float]]:
    """(label, keyword, words as a pattern, priority, weight), in order, the base phrases first."""
    out = [(label, phrase.split()[0], phrase, 2, 0.9) for label, phrase in BASE]
    return out + [(label, keyword, words, priority, WEIGHTS[priority]) for label, keyword, words, priority in SIGNATURES]


def blanks(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit("")))


def canonical(text: Column) -> Column:
    """The words of a text with one space before, between and after them; empty without words."""
    text = F.regexp_replace(F.coalesce(text, F.lit("")), r"(?<=[0-9])\+(?![0-9A-Za-z+\x{80}-\x{10FFFF}])", PLUS)
    words = F.trim(F.regexp_replace(text, r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]++", " "))
    return F.when(words == "", "").otherwise(F.concat(F.lit(" "), words, F.lit(" ")))


def whole(pattern: str) -> str:
    """A pattern of words, A-Z in either case, that begins and ends with a word."""
    return f"(?i)(?<= )(?:{pattern})(?= )"


def places(canon: Column, pattern: Column) -> Column:
    """First word and end of each match, left to right: array of ``struct(s, e)``."""

    def placed(at: Column) -> Column:
        s = at["before"] + at["x"]["g"] - 1
        return F.struct(s.alias("s"), (s + at["x"]["f"] + 1).alias("e"))

    def zipped(found: Column) -> Column:
        gaps = F.slice(F.split(canon, pattern, -1), 1, F.size(found))
        words = F.transform(F.arrays_zip(gaps.alias("g"), found.alias("f")), lambda x: F.struct(blanks(x["g"]).alias("g"), blanks(x["f"]).alias("f")))
        return F.transform(running(words, lambda x: x["g"] + x["f"], lambda a, b: a + b, 0), placed)

    return let(F.regexp_extract_all(canon, pattern, F.lit(0)), zipped)


def detections(canon: Column, keywords: Column) -> Column:
    """All detections of the rules whose keyword the text has, in the order of suppression."""
    table = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(whole(p)).alias("p"), F.lit(label).alias("l"), F.lit(prio).alias("prio"), F.lit(w).alias("w")) for label, k, p, prio, w in rules()])

    def of(rule: Column) -> Column:
        return F.transform(places(canon, rule["p"]), lambda x: F.struct(x["s"].alias("s"), (-x["e"]).alias("e"), (-rule["prio"]).alias("prio"), rule["l"].alias("l"), (-rule["w"]).alias("w")))

    return F.array_sort(F.flatten(F.transform(F.filter(table, lambda r: F.array_contains(keywords, r["k"])), of)))


def kept(found: Column) -> Column:
    """Labels and the largest weight of what no detection of the same or a higher priority
    contains: one pass with the farthest end so far of each priority; then the names, or else the shared
    sentences, or else the hints."""
    nothing = [c for t in (0, 1, 2) for c in (F.array().cast("array<string>").alias(f"l{t}"), F.lit(0.0).alias(f"w{t}"))]
    first = F.struct(*[F.lit(0).alias(f"m{p}") for p in WEIGHTS], *nothing)

    def step(acc: Column, d: Column) -> Column:
        end, prio = -d["e"], -d["prio"]
        inside = F.element_at(F.array(*[acc[f"m{p}"] for p in WEIGHTS]), prio + 1) >= end
        ends = [F.when(prio >= p, F.greatest(acc[f"m{p}"], end)).otherwise(acc[f"m{p}"]).alias(f"m{p}") for p in WEIGHTS]
        out = []
        for t in (0, 1, 2):
            new = ~inside & (F.least(prio, F.lit(2)) == t)
            out += [F.when(new, F.array_union(acc[f"l{t}"], F.array(d["l"]))).otherwise(acc[f"l{t}"]).alias(f"l{t}"), F.when(new, F.greatest(acc[f"w{t}"], -d["w"])).otherwise(acc[f"w{t}"]).alias(f"w{t}")]
        return F.struct(*ends, *out)

    def best(acc: Column) -> Column:
        tier = lambda t: F.struct(acc[f"l{t}"].alias("labels"), acc[f"w{t}"].alias("w"))
        return F.when(F.size(acc["l2"]) > 0, tier(2)).when(F.size(acc["l1"]) > 0, tier(1)).otherwise(tier(0))

    return F.aggregate(found, first, step, best)


def scan(docs: DataFrame) -> DataFrame:
    """All rows and columns of ``docs`` plus ``n_words, n_base, first_word, last_word,
    base_labels, labels, score`` (the largest weight of a kept detection, 0 without one).

    Null texts count as empty: no words, no labels, null places, score 0.  Whole texts are
    scanned; repeated rows alike; clashing columns are replaced; an empty table gives an
    empty result.
    """
    docs = docs.drop("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "_canon", "_base", "_kept")
    gate = "|".join(sorted({k for _, k, _, _, _ in rules()}))
    rows = docs.withColumn("_canon", canonical(F.col("text")))
    nothing = F.struct(F.array().cast("array<string>").alias("labels"), F.lit(0.0).alias("w"))

    def found(canon: Column) -> Column:
        keywords = F.array_distinct(F.transform(F.regexp_extract_all(canon, F.lit(whole(gate)), F.lit(0)), F.lower))
        return let(keywords, lambda ks: F.struct(kept(detections(canon, ks)).alias("kept"), F.array(*[places(canon, F.lit(whole(p))) for _, p in BASE]).alias("base")))

    some = F.when(F.col("_canon").rlike(whole(gate)), let(F.col("_canon"), found))
    rows = rows.withColumn("_found", some)
    base = F.coalesce(F.col("_found.base"), F.array().cast("array<array<struct<s:int,e:int>>>"))
    rows = rows.withColumns({"_base": F.transform(F.flatten(base), lambda x: x["s"]), "_labels": F.array(*[F.when(F.size(F.col("_found.base")[i]) > 0, label) for i, (label, _) in enumerate(BASE)]), "_kept": F.coalesce("_found.kept", nothing)})
    own = F.array_compact("_labels")
    return rows.select(
        *docs.columns,
        F.greatest(blanks(F.col("_canon")) - 1, F.lit(0)).cast("bigint").alias("n_words"),
        F.size("_base").cast("bigint").alias("n_base"),
        F.array_min("_base").cast("bigint").alias("first_word"),
        F.array_max("_base").cast("bigint").alias("last_word"),
        F.array_join(F.array_sort(own), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union(own, F.col("_kept.labels"))), ",").alias("labels"),
        F.col("_kept.w").alias("score"),
    )


def phrases(pattern: str) -> list[str]:
    """All word sequences of a rule's pattern: groups, choices, optional parts and letters written out."""

    def choice(at: int) -> tuple[list[str], int]:
        ways, now = [], [""]
        while at < len(pattern) and pattern[at] != ")":
            if pattern[at] == "|":
                ways, now, at = ways + now, [""], at + 1
                continue
            if pattern.startswith("(?:", at):
                part, at = choice(at + 3)
                at += 1
            elif pattern[at] == "[":
                end = pattern.index("]", at)
                part, at = list(pattern[at + 1 : end]), end + 1
            else:
                part, at = [pattern[at]], at + 1
            if at < len(pattern) and pattern[at] == "?":
                part, at = [*part, ""], at + 1
            now = [a + b for a in now for b in part]
        return ways + now, at

    return sorted(set(choice(0)[0]))


def oracle() -> str:
    """The scan as SQL: phrases written out and sought by word place, containment by a join."""
    values = ",\n".join(f"('{label}', '{keyword}', '{phrase}', {prio}, {weight})" for label, keyword, p, prio, weight in rules() for phrase in phrases(p))
    base = ", ".join(f"('{label}', '{p}')" for label, p in BASE)
    return f"""
    WITH docs AS (
        SELECT doc_id, regexp_extract_all(translate(regexp_replace(COALESCE(text, ''), '([0-9])\\+($|[^0-9A-Za-z+\\x{{80}}-\\x{{10FFFF}}])', '\\1{PLUS}\\2', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS ws
        FROM documents
    ), rules(label, keyword, phrase, prio, w) AS (VALUES {values}),
    base(label, phrase) AS (VALUES {base}),
    words AS (
        SELECT doc_id, ws, UNNEST(range(len(ws))) AS i FROM docs
    ), base_hits AS (
        SELECT doc_id, label, i FROM words JOIN base ON ws[i + 1] = string_split(phrase, ' ')[1]
        AND list_slice(ws, i + 1, i + len(string_split(phrase, ' '))) = string_split(phrase, ' ')
    ), hits AS (
        SELECT DISTINCT doc_id, label, i AS s, i + len(string_split(phrase, ' ')) AS e, prio, w FROM words JOIN rules ON ws[i + 1] = string_split(phrase, ' ')[1]
        AND list_slice(ws, i + 1, i + len(string_split(phrase, ' '))) = string_split(phrase, ' ') AND list_contains(ws, keyword)
    ), free AS (
        SELECT * FROM hits d WHERE NOT EXISTS (
            SELECT 1 FROM hits e WHERE e.doc_id = d.doc_id AND e.s <= d.s AND e.e >= d.e AND e.prio >= d.prio
            AND (e.s < d.s OR e.e > d.e OR e.prio > d.prio OR e.label < d.label))
    ), kept AS (
        SELECT * FROM free d WHERE least(prio, 2) = (SELECT MAX(least(prio, 2)) FROM free e WHERE e.doc_id = d.doc_id)
    ), b AS (
        SELECT doc_id, COUNT(*) AS n_base, MIN(i) AS first_word, MAX(i) AS last_word FROM base_hits GROUP BY doc_id
    ), labels AS (
        SELECT doc_id, label FROM kept UNION SELECT doc_id, label FROM base_hits
    )
    SELECT d.doc_id, len(ws) AS n_words, COALESCE(n_base, 0) AS n_base, first_word, last_word,
        COALESCE((SELECT string_agg(label, ',' ORDER BY label) FROM (SELECT DISTINCT h.label FROM base_hits h WHERE h.doc_id = d.doc_id)), '') AS base_labels,
        COALESCE((SELECT string_agg(label, ',' ORDER BY label) FROM labels l WHERE l.doc_id = d.doc_id), '') AS labels,
        CAST(COALESCE((SELECT MAX(w) FROM kept k WHERE k.doc_id = d.doc_id), 0) AS DOUBLE) AS score
    FROM docs d LEFT JOIN b ON b.doc_id = d.doc_id
    """
