"""License scans by ordered signature rules, as column functions only.

A few thousand licences speak in set phrases, so the rules are made from a plain list of names: for each licence its
identifier tag (in the first three places of an expression), its grant ("licensed under the X"), its title and its address; notices with
versions, short names and the texts of clauses are written out one by one. A text reaches the
patterns only if it holds one of the STEMS, which are taken from the rules, and each pattern only if the text holds the
rule's own keyword. Before that, line breaks with their comment marks and runs of blanks become one blank, as the patterns
have it. The hits of a document form intervals; rules have priorities (tag before grant before address before title), and a hit that lies inside
another hit of the same or a better priority is suppressed. What is left gives labels and the score.

Beside the rules, fixed phrases are matched on words; their labels always stay.

Defined cases: a null text counts as empty: no words, no labels, score 0; an empty table gives no rows; repeated rows are
scanned one by one; texts of any length are scanned whole; equal hits of one interval keep the rule that comes first;
other columns are ignored.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanlake.llm.common import ascii_lower

#: Phrases of the base scan and their labels.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

#: label :: identifiers, comma-separated :: title pattern :: address pattern; lower case, - for none.
LICENSES = r"""
agpl :: agpl-3.0,agpl-3.0-only,agpl-3.0-or-later,agpl-1.0 :: gnu affero general public licen[sc]e :: gnu\.org/licenses/agpl
lgpl :: lgpl-2.1,lgpl-3.0,lgpl-2.1-only,lgpl-3.0-or-later :: gnu (?:lesser|library) general public licen[sc]e :: gnu\.org/licenses/lgpl
gpl :: gpl-2.0,gpl-3.0,gpl-2.0-only,gpl-2.0-or-later,gpl-3.0-only,gpl-3.0-or-later :: gnu general public licen[sc]e :: gnu\.org/licenses/gpl
gfdl :: gfdl-1.1,gfdl-1.2,gfdl-1.3 :: gnu free documentation licen[sc]e :: gnu\.org/licenses/fdl
apache :: apache-2.0,apache-1.1,apache-1.0 :: apache (?:software )?licen[sc]e :: apache\.org/licenses/
mit :: mit,mit-0,x11 :: (?:mit|expat|x11) licen[sc]e :: opensource\.org/licenses/mit
bsd-2 :: bsd-2-clause :: (?:simplified|freebsd|2-clause) bsd licen[sc]e :: opensource\.org/licenses/bsd-2-clause
bsd-3 :: bsd-3-clause :: (?:modified|revised|new|3-clause) bsd licen[sc]e :: opensource\.org/licenses/bsd-3-clause
bsd-4 :: bsd-4-clause :: (?:original|4-clause) bsd licen[sc]e :: -
bsd :: 0bsd,bsd-1-clause :: (?:zero-clause )?bsd licen[sc]e :: -
isc :: isc :: isc licen[sc]e :: opensource\.org/licenses/isc
mpl :: mpl-1.0,mpl-1.1,mpl-2.0 :: mozilla public licen[sc]e :: mozilla\.org/mpl
epl :: epl-1.0,epl-2.0 :: eclipse public licen[sc]e :: eclipse\.org/legal/epl
edl :: - :: eclipse distribution licen[sc]e :: eclipse\.org/org/documents/edl
cddl :: cddl-1.0,cddl-1.1 :: common development and distribution licen[sc]e :: opensource\.org/licenses/cddl
cpl :: cpl-1.0 :: common public licen[sc]e :: -
ipl :: ipl-1.0 :: ibm public licen[sc]e :: -
artistic :: artistic-1.0,artistic-2.0 :: (?:clarified )?artistic licen[sc]e :: perlfoundation\.org/artistic
zlib :: zlib :: zlib(?:/libpng)? licen[sc]e :: zlib\.net/zlib_license
libpng :: libpng-2.0 :: libpng licen[sc]e :: libpng\.org/pub/png/src/libpng-license
boost :: bsl-1.0 :: boost software licen[sc]e :: boost\.org/license
unlicense :: unlicense :: the unlicen[sc]e :: unlicense\.org
wtfpl :: wtfpl :: do what the fuck you want to public licen[sc]e :: wtfpl\.net
cc0 :: cc0-1.0 :: (?:cc0|cc zero|creative commons zero)(?: 1\.0)?(?: universal)?(?: licen[sc]e)? :: creativecommons\.org/publicdomain/zero
cc-by-nc-nd :: cc-by-nc-nd-4.0,cc-by-nc-nd-3.0 :: cc[ -]by-nc-nd(?: \d\.\d)? :: creativecommons\.org/licenses/by-nc-nd
cc-by-nc-sa :: cc-by-nc-sa-4.0,cc-by-nc-sa-3.0 :: cc[ -]by-nc-sa(?: \d\.\d)? :: creativecommons\.org/licenses/by-nc-sa
cc-by-nc :: cc-by-nc-4.0,cc-by-nc-3.0 :: cc[ -]by-nc(?: \d\.\d)? :: creativecommons\.org/licenses/by-nc/
cc-by-nd :: cc-by-nd-4.0,cc-by-nd-3.0 :: cc[ -]by-nd(?: \d\.\d)? :: creativecommons\.org/licenses/by-nd
cc-by-sa :: cc-by-sa-4.0,cc-by-sa-3.0 :: cc[ -]by-sa(?: \d\.\d)? :: creativecommons\.org/licenses/by-sa
cc-by :: cc-by-4.0,cc-by-3.0,cc-by-2.0 :: cc[ -]by(?: \d\.\d)? :: creativecommons\.org/licenses/by/
cc :: - :: creative commons (?:attribution|licen[sc]e|public licen[sc]e) :: creativecommons\.org/licenses
odbl :: odbl-1.0 :: open (?:database|data commons open database) licen[sc]e :: opendatacommons\.org/licenses/odbl
pddl :: pddl-1.0 :: public domain dedication (?:and|&) licen[sc]e :: opendatacommons\.org/licenses/pddl
odc-by :: odc-by-1.0 :: open data commons attribution licen[sc]e :: opendatacommons\.org/licenses/by
cdla :: cdla-permissive-1.0,cdla-permissive-2.0,cdla-sharing-1.0 :: community data licen[sc]e agreement :: cdla\.(?:io|dev)
ofl :: ofl-1.0,ofl-1.1 :: (?:sil )?open font licen[sc]e :: scripts\.sil\.org/ofl
eupl :: eupl-1.1,eupl-1.2 :: european union public licen[sc]e :: joinup\.ec\.europa\.eu
osl :: osl-1.0,osl-2.1,osl-3.0 :: open software licen[sc]e :: opensource\.org/licenses/osl
afl :: afl-2.1,afl-3.0 :: academic free licen[sc]e :: opensource\.org/licenses/afl
ecl :: ecl-1.0,ecl-2.0 :: educational community licen[sc]e :: opensource\.org/licenses/ecl
qpl :: qpl-1.0 :: q public licen[sc]e :: -
php :: php-3.0,php-3.01 :: php licen[sc]e :: php\.net/license
python :: python-2.0,psf-2.0 :: python (?:software foundation )?licen[sc]e :: python\.org/psf/license
ruby :: ruby :: ruby licen[sc]e :: ruby-lang\.org/en/about/license
vim :: vim :: vim licen[sc]e :: -
openssl :: openssl :: openssl licen[sc]e :: openssl\.org/source/license
postgresql :: postgresql :: postgresql licen[sc]e :: postgresql\.org/about/licence
ncsa :: ncsa :: (?:university of illinois/)?ncsa (?:open source )?licen[sc]e :: -
w3c :: w3c :: w3c (?:software )?(?:notice and )?licen[sc]e :: w3\.org/consortium/legal
upl :: upl-1.0 :: universal permissive licen[sc]e :: opensource\.org/licenses/upl
ms-pl :: ms-pl :: microsoft public licen[sc]e :: opensource\.org/licenses/ms-pl
ms-rl :: ms-rl :: microsoft reciprocal licen[sc]e :: opensource\.org/licenses/ms-rl
mulan :: mulanpsl-1.0,mulanpsl-2.0 :: mulan permissive software licen[sc]e :: license\.coscl\.org\.cn
cecill :: cecill-1.0,cecill-2.0,cecill-2.1,cecill-b,cecill-c :: cecill(?:-[bc])? (?:free software )?licen[sc]e :: cecill\.info
sspl :: sspl-1.0 :: server side public licen[sc]e :: mongodb\.com/licensing/server-side
busl :: busl-1.1 :: business source licen[sc]e :: mariadb\.com/bsl
elastic :: elastic-2.0 :: elastic licen[sc]e :: elastic\.co/licensing
openrail :: openrail,bigscience-openrail-m,creativeml-openrail-m :: (?:creativeml |bigscience )?open ?rail(?:-m|\+\+)? licen[sc]e :: licenses\.ai
beerware :: beerware :: (?:the )?beer-?ware licen[sc]e :: -
json :: json :: the software shall be used for good, not evil :: json\.org/license
lppl :: lppl-1.3c :: latex project public licen[sc]e :: latex-project\.org/lppl
nasa :: nasa-1.3 :: nasa open source agreement :: -
public-domain :: - :: (?:released|placed|dedicated|is) (?:in|into|to) the public domain :: creativecommons\.org/publicdomain/mark
proprietary :: - :: all rights reserved :: -
"""

#: Notices and short names with their versions, written out: label :: keyword :: pattern.
NOTICES = r"""
agpl :: free software :: this (?:program|software|library|file) is free software[:;,]? you can redistribute it and/or modify it under the terms of (?:version \d of )?the gnu affero general public licen[sc]e
lgpl :: free software :: this (?:program|software|library|file) is free software[:;,]? you can redistribute it and/or modify it under the terms of (?:version \d(?:\.\d)? of )?the gnu (?:lesser|library) general public licen[sc]e
gpl :: free software :: this (?:program|software|library|file) is free software[:;,]? you can redistribute it and/or modify it under the terms of (?:version \d of )?the gnu general public licen[sc]e
gpl :: gnu gpl :: gnu gpl(?:,? (?:version |v\.? ?)[123](?:\.0)?)?(?:,? or (?:\(at your option\) )?(?:any )?later(?: version)?|\+)?(?!\w)
gpl :: gplv :: (?<!\w)gplv[123](?:\.0)?\+?(?!\w)
gpl :: gpl v :: (?<!\w)gpl v(?:ersion |\. ?)?[123](?:\.0)?\+?(?!\w)
gpl :: gpl-compatible :: (?<!\w)gpl-compatible(?!\w)
lgpl :: gnu lgpl :: gnu lgpl(?:,? (?:version |v\.? ?)[23](?:\.[01])?)?\+?(?!\w)
lgpl :: lgplv :: (?<!\w)lgplv[23](?:\.[01])?\+?(?!\w)
lgpl :: lgpl v :: (?<!\w)lgpl v(?:ersion |\. ?)?[23](?:\.[01])?\+?(?!\w)
agpl :: gnu agpl :: gnu agpl(?:,? (?:version |v\.? ?)3(?:\.0)?)?\+?(?!\w)
agpl :: agplv :: (?<!\w)agplv3(?:\.0)?\+?(?!\w)
agpl :: agpl v :: (?<!\w)agpl v(?:ersion |\. ?)?3(?:\.0)?\+?(?!\w)
apache :: apache 2 :: (?<!\w)apache 2(?:\.0)?(?: licen[sc]ed?)?(?!\w)
apache :: apache license :: apache license,? (?:version |v\.? ?)2(?:\.0)?(?!\w)
apache :: apache-2 :: licen[sc]ed under apache-2(?:\.0)?(?!\w)
asl :: asl 2 :: (?<!\w)asl 2\.0(?!\w)
bsd-3 :: bsd 3-clause :: (?<!\w)bsd 3-clause(?: licen[sc]e)?(?!\w)
bsd-2 :: bsd 2-clause :: (?<!\w)bsd 2-clause(?: licen[sc]e)?(?!\w)
bsd-4 :: bsd 4-clause :: (?<!\w)bsd 4-clause(?: licen[sc]e)?(?!\w)
bsd :: bsd-style :: (?<!\w)bsd-style licen[sc]e(?!\w)
mit :: mit-style :: (?<!\w)mit-style licen[sc]e(?!\w)
mit :: mit/x11 :: (?<!\w)mit/x11(?: licen[sc]e)?(?!\w)
mpl :: mpl 2 :: (?<!\w)mpl 2\.0(?!\w)
mpl :: mpl 1 :: (?<!\w)mpl 1\.[01](?!\w)
mpl :: mozilla public :: subject to the terms of the mozilla public licen[sc]e,? (?:version |v\. ?)[12]\.[01]
epl :: epl 2 :: (?<!\w)epl 2\.0(?!\w)
epl :: eclipse public :: made available under the terms of the eclipse public licen[sc]e,? (?:version |v ?)[12]\.0
eupl :: eupl v :: (?<!\w)eupl v(?:ersion |\. ?)?1\.[12](?!\w)
cc-by-sa :: attribution-sharealike :: (?:creative commons )?attribution-sharealike(?: \d\.\d)?(?: international| unported)?(?: public)?(?: licen[sc]e)?(?!\w)
cc-by-nc-sa :: attribution-noncommercial-sharealike :: (?:creative commons )?attribution-noncommercial-sharealike(?: \d\.\d)?(?: international| unported)?(?!\w)
cc-by-nc-nd :: attribution-noncommercial-noderiv :: (?:creative commons )?attribution-noncommercial-noderiv(?:s|atives)(?: \d\.\d)?(?: international| unported)?(?!\w)
cc-by-nc :: attribution-noncommercial :: (?:creative commons )?attribution-noncommercial(?: \d\.\d)?(?: international| unported)?(?![\w-])
cc-by-nd :: attribution-noderiv :: (?:creative commons )?attribution-noderiv(?:s|atives)(?: \d\.\d)?(?: international| unported)?(?!\w)
cc-by :: attribution :: creative commons attribution \d\.\d(?: international| unported)?(?: public)?(?: licen[sc]e)?(?!\w)
public-domain :: public domain :: the author (?:hereby )?disclaims copyright to this source code
not-gpl :: gpl :: (?<!\w)not (?:licen[sc]ed |released |available |distributed )?under (?:the )?(?:terms of (?:the )?)?(?:gnu )?gpl(?!\w)
not-gpl :: general public licen :: (?<!\w)not (?:licen[sc]ed |released |available |distributed )?under (?:the )?(?:terms of (?:the )?)?gnu general public licen[sc]e(?!\w)
"""

#: Text of well-known clauses, written out: label :: keyword :: pattern.
CLAUSES = r"""
mit :: permission is hereby granted :: permission is hereby granted, free of charge, to any person obtaining a copy
mit :: the above copyright notice and this permission notice :: the above copyright notice and this permission notice(?: \(including the next paragraph\))? shall be included in all copies or substantial portions of the software
boost :: permission is hereby granted :: permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation
isc :: permission to use, copy, modify :: permission to use, copy, modify,? and(?:/or)? distribute this software for any purpose
hpnd :: without fee is hereby granted :: permission to use, copy, modify,? (?:and )?distribute,? (?:and sell )?this software and its documentation for any purpose(?: and)?(?: is hereby granted)? without fee is hereby granted
bsd :: redistribution and use in source :: (?:all rights reserved\.? )?redistribution and use in source and binary forms, with or without modification
bsd-3 :: endorse or promote products :: neither the name of [^.]{1,120} may be used to endorse or promote products derived from this software without specific prior written permission
bsd-4 :: all advertising materials :: all advertising materials mentioning features or use of this software must display the following acknowledg(?:e)?ment
gpl :: you can redistribute it and/or modify :: this program is free software[:;] you can redistribute it and/or modify
gpl :: freedom to share and change it :: the licen[sc]es for most software (?:and other practical works )?are designed to take away your freedom to share and change
lgpl :: lesser general public :: this (?:version of the )?gnu lesser general public licen[sc]e incorporates the terms and conditions
agpl :: remote network interaction :: remote network interaction; use with the gnu general public licen[sc]e
gfdl :: free documentation :: permission is granted to copy, distribute and/or modify this document under the terms of the gnu free documentation licen[sc]e
apache :: except in compliance with the licen :: you may not use this file except in compliance with the licen[sc]e
apache :: perpetual, worldwide, non-exclusive :: each contributor hereby grants to you a perpetual, worldwide, non-exclusive, no-charge, royalty-free, irrevocable copyright licen[sc]e
mpl :: this source code form is subject :: this source code form is subject to the terms of the mozilla public licen[sc]e
mpl :: contents of this file are subject :: the contents of this file are subject to the mozilla public licen[sc]e
epl :: agreement :: the accompanying program is provided under the terms of this eclipse public licen[sc]e
cpl :: agreement :: the accompanying program is provided under the terms of this common public licen[sc]e
ipl :: agreement :: the accompanying program is provided under the terms of this ibm public licen[sc]e
cddl :: contents of this file are subject :: the contents of this file are subject to the terms of the common development and distribution licen[sc]e
eupl :: the eupl :: licen[sc]ed under the eupl(?:,? version 1\.[0-2])?(?!\w)
artistic :: artistic control :: the copyright holder maintains some semblance of artistic control over the development of the package
zlib :: provided 'as-is' :: this software is provided 'as-is', without any express or implied warranty
zlib :: must not be misrepresented :: the origin of this software must not be misrepresented; you must not claim that you wrote the original software
libpng :: plainly marked :: altered versions must be plainly marked as such and must not be misrepresented as being the original source
unlicense :: unencumbered software :: this is free and unencumbered software released into the public domain
wtfpl :: you just do what :: you just do what the fuck you want to
beerware :: buy me a beer :: if we meet some day, and you think this stuff is worth it, you can buy me a beer in return
cc0 :: waive :: to the extent possible under law,? [^.]{1,120} waived all copyright and related or neighboring rights
openssl :: openssl toolkit :: this product includes software developed by the openssl project for use in the openssl toolkit
ssleay :: eric young :: this product includes cryptographic software written by eric young
php :: php software :: this product includes php software, freely available from
python :: python software foundation :: psf hereby grants licensee a nonexclusive, royalty-free, world-wide licen[sc]e to reproduce
postgresql :: university of california :: in no event shall the university of california be liable to any party
ncsa :: deal with the software :: to deal with the software without restriction, including without limitation the rights to use, copy, modify
w3c :: w3c :: by obtaining,? using and/or copying this work, you \(the licensee\) agree
upl :: larger works :: the larger works? to which the software is contributed
ofl :: reserved font name :: this font software is licen[sc]ed under the sil open font licen[sc]e
ofl :: reserved font name :: no modified version of the font software may use the reserved font name
ms-pl :: patent claims :: each contributor grants you a non-exclusive, worldwide, royalty-free licen[sc]e under its licen[sc]ed patent claims
sspl :: service source code :: you must make the service source code available via network download to everyone at no charge
busl :: change date :: effective on the change date, or the fourth anniversary of the first publicly available distribution
elastic :: hosted or managed service :: you may not provide the software to third parties as a hosted or managed service
commons-clause :: commons clause :: the software is provided to you by the licensor under the licen[sc]e, as defined below, subject to the following condition
json :: good, not evil :: the software shall be used for good, not evil
openrail :: use-based restrictions :: use-based restrictions as referenced in paragraph 5 must be included
odbl :: produced work :: any produced work that you publicly convey must be accompanied by a notice
cc :: exercise the licensed rights :: a worldwide, royalty-free, non-sublicensable, non-exclusive, irrevocable licen[sc]e to exercise the licen[sc]ed rights
proprietary :: permission :: (?:no part of|may not be) [^.\n]{0,120}(?:reproduced|copied|distributed)[^.\n]{0,80}without (?:prior |written )*permission
proprietary :: confidential :: (?:proprietary and confidential|confidential and proprietary)
proprietary :: trade secret :: (?:contains|constitutes?) (?:valuable )?trade secrets? of
copyleft :: alike :: (?:attribution[ -])(?:non-?commercial[ -])?share[ -]?alike
"""

#: A line break with the blanks and comment marks around it, or a run of blanks; one blank stands for it.
WRAP = r"[ \t\x0B\f\r]*+(?:(?<=[ \t\x0B\f\r])[*#/;%!>|-]++[ \t\x0B\f\r]*+)?\n[ \t\x0B\f\r\n]*+(?:[*#/;%!>|-]++[ \t\x0B\f\r\n]*+){0,3}|[ \t\x0B\f\r]{2,}+|[\t\x0B\f\r]"

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WORD_ANY_CASE = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

SPDX = "spdx-license-identifier:"
TAG, SECOND, THIRD, GRANT, CLAUSE, ADDRESS, TITLE = range(7)
SCORE = {TAG: 1.0, SECOND: 1.0, THIRD: 1.0, GRANT: 0.95, CLAUSE: 0.9, ADDRESS: 0.85, TITLE: 0.7}


def runs(pattern: str) -> list[str]:
    """The literal runs that every match of a pattern holds."""
    outside = re.sub(r"\(\?:(?:[^()]|\([^()]*\))*\)\??|\[[^\]]*\](?:\{[^}]*\})?\??|[\w ,-]\?|\\d", "\0", pattern)
    return re.sub(r"\\(.)", r"\1", outside).split("\0")


def keyword(pattern: str) -> str:
    """The longest literal run that every match of a pattern holds."""
    return max(runs(pattern), key=len)


def rules() -> list[tuple[int, str, str, str]]:
    """(priority, label, keyword, pattern), in the order in which they are tried."""
    found = []
    gap = r"[ \t\n]+"
    grant = rf"(?:licen[sc]ed|released|distributed|available|published|covered){gap}(?:\w+{gap})?(?:under|by){gap}"
    grant += rf"(?:the{gap})?(?:terms{gap}of{gap}(?:the{gap})?)?"
    part = r"[\w.+-]+\)?[ \t]+(?:and|or|with)[ \t(]+"
    for line in LICENSES.strip().splitlines():
        label, ids, title, address = line.split(" :: ")
        for name in ids.split(",") if ids != "-" else ():
            for kind, n in ((TAG, 0), (SECOND, 1), (THIRD, 2)):  # a place of its own in an expression, as longer hits hold shorter ones
                found.append((kind, label, name, rf"{SPDX}[ \t(]*{part * n}{re.escape(name)}\+?(?![\w.+-])"))
        found.append((GRANT, label, keyword(title), rf"{grant}{title}(?!\w)"))
        found.append((TITLE, label, keyword(title), rf"(?<!\w){title}(?!\w)"))
        if address != "-":
            found.append((ADDRESS, label, keyword(address), address))
    for kind, lines in ((GRANT, NOTICES), (CLAUSE, CLAUSES)):
        for line in lines.strip().splitlines():
            label, word, pattern = line.split(" :: ")
            longest = keyword(pattern)
            sure = any(word in r for r in runs(pattern)) or len(longest) < 5  # a word of every branch is named in the line
            found.append((kind, label, word if sure else longest, pattern))
    return sorted(found, key=lambda r: r[0])


#: What a match holds if its rule has no keyword of some length.
SHORT = {"not-gpl": ("gpl",), "cc0": ("cc0", "cc zero", "creative commons zero"), "cc-by": ("cc by", "cc-by")}


def stems() -> tuple[str, ...]:
    """Words of which every hit of any rule holds one."""
    found = set()
    for priority, label, word, pattern in rules():
        if priority in (TAG, SECOND, THIRD):
            found.add(SPDX)
        elif priority in (GRANT, TITLE) and any("licen" in r for r in runs(pattern)):
            found.add("licen")
        else:
            found |= {word} if len(word) > 3 else set(SHORT[label])
    return tuple(sorted(w for w in found if not any(v in w for v in found - {w})))


#: A text without any of these holds no licence that the rules know.
STEMS = stems()

CHUNK = 256
HITS = "array<struct<b:int,e:int,p:int,i:int>>"


def hits(lower: Column, some: list[tuple[int, str, str, str]]) -> Column:
    """All hits of the rules in a lower-cased text: array of (begin, -end, priority, rule), unordered.

    The gaps before the hits of a pattern and the hits alternate, so running sums of their lengths give the places. The
    sums are taken in chunks, since an array grown by one is copied.
    """
    fields = ("p", "i", "k", "x")
    listed = F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip(fields, (p, i, k, x), strict=True)]) for i, (p, _, k, x) in enumerate(some)])

    def places(r: Column) -> Column:
        sizes = F.transform(F.regexp_extract_all(lower, r["x"], F.lit(0)), F.char_length)
        both = F.zip_with(
            F.transform(F.split(lower, r["x"], -1), F.char_length), sizes, lambda g, s: F.struct(g.alias("g"), s.alias("s"))
        )
        full = F.filter(both, lambda z: z["s"].isNotNull())  # the last gap has no hit after it
        chunks = F.transform(full, lambda z, n: F.when(n % CHUNK == 0, F.slice(full, n + 1, F.lit(CHUNK))))
        begun = F.aggregate(
            F.filter(chunks, lambda c: c.isNotNull()),
            F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<at:int,c:array<struct<g:int,s:int>>>>").alias("out")),
            lambda a, c: F.struct(
                F.aggregate(c, a["at"], lambda n, z: n + z["g"] + z["s"]).alias("at"),
                F.concat(a["out"], F.array(F.struct(a["at"].alias("at"), c.alias("c")))).alias("out"),
            ),
            lambda a: a["out"],
        )

        def walk(a: Column, z: Column) -> Column:
            begin = a["at"] + z["g"]
            hit = F.struct(begin.alias("b"), (-begin - z["s"]).alias("e"), r["p"].alias("p"), r["i"].alias("i"))
            return F.struct((begin + z["s"]).alias("at"), F.concat(a["out"], F.array(hit)).alias("out"))

        start = lambda c: F.struct(c["at"].alias("at"), F.array().cast(HITS).alias("out"))
        return F.flatten(F.transform(begun, lambda c: F.aggregate(c["c"], start(c), walk, lambda a: a["out"])))

    return F.flatten(F.transform(F.filter(listed, lambda r: F.contains(lower, r["k"])), places))


def outermost(found: Column) -> Column:
    """Of sorted hits, the rules and best priority of those that lie in no hit of the same or a better priority."""
    levels = range(len(SCORE))
    start = F.struct(
        *[F.lit(-1).alias(f"m{q}") for q in levels], F.array().cast("array<int>").alias("rules"), F.lit(None).cast("int").alias("best")
    )

    def take(a: Column, h: Column) -> Column:
        end = -h["e"]
        reach = F.greatest(*[F.when(h["p"] >= q, a[f"m{q}"]).otherwise(-1) for q in levels])
        kept = reach < end
        return F.struct(
            *[F.when(h["p"] == q, F.greatest(a[f"m{q}"], end)).otherwise(a[f"m{q}"]).alias(f"m{q}") for q in levels],
            F.when(kept, F.array_union(a["rules"], F.array(h["i"]))).otherwise(a["rules"]).alias("rules"),
            F.when(kept, F.least(a["best"], h["p"])).otherwise(a["best"]).alias("best"),
        )

    return F.aggregate(found, start, take)


def phrase_places(words: Column, phrase: str) -> Column:
    """Word positions at which a phrase's words stand one after the other."""
    every = F.transform(words, lambda w, i: F.when(w == phrase.split()[0], i))
    rest = list(enumerate(phrase.split()))[1:]

    def here(i: Column) -> Column:
        match = i.isNotNull()
        for n, w in rest:
            match = match & F.coalesce(F.get(words, i + n) == w, F.lit(False))
        return match

    return F.filter(every, here)


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score and rules (the kept rules' patterns)."""
    some = rules()
    # full lower case is cheap and holds every stem that the lower-cased A-Z hold, so it serves as the gate
    raw = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("raw"))
    low = raw.withColumn("low", F.lower("raw"))
    low = low.withColumn("flat", F.regexp_replace("low", WRAP, " "))
    stem = F.lit(False)
    for s in STEMS:
        stem = stem | F.contains("flat", F.lit(s))
    gated = low.select(
        "doc_id",
        F.regexp_count("raw", F.lit(WORD_ANY_CASE)).cast("long").alias("n_words"),
        F.when(stem, F.regexp_replace(ascii_lower(F.col("raw")), WRAP, " ")).alias("t"),
        F.when(F.contains("low", F.lit("license")) | F.contains("low", F.lit("cc")), ascii_lower(F.col("raw"))).alias("b"),
    )
    read = gated.select(
        "doc_id",
        "t",
        F.col("t").isNotNull().alias("gate"),
        "n_words",
        F.when(F.col("b").isNotNull(), F.regexp_extract_all("b", F.lit(WORD), F.lit(0))).alias("w"),
    )
    found = read.select(
        "doc_id",
        "n_words",
        *[F.coalesce(phrase_places(F.col("w"), p), F.array().cast("array<int>")).alias(f"b{n}") for n, p in enumerate(PHRASES)],
        F.when(F.col("gate"), F.array_sort(hits(F.col("t"), some))).alias("hits"),
    )
    places = [F.col(f"b{n}") for n in range(len(PHRASES))]
    labels = F.array(*[F.lit(label) for _, label, _, _ in some])
    none = F.array().cast("array<string>")
    told = found.select(
        "doc_id",
        "n_words",
        F.concat(*places).alias("at"),
        F.concat(*[F.when(F.size(b) > 0, F.array(F.lit(label))).otherwise(none) for b, label in zip(places, PHRASES.values(), strict=True)]).alias("base"),
        F.when(F.size("hits") > 0, outermost(F.col("hits"))).alias("kept"),
    )
    score = F.element_at(F.create_map(*[F.lit(x) for p in SCORE.items() for x in p]), F.col("kept.best"))
    extra = F.coalesce(F.transform(F.col("kept.rules"), lambda i: F.get(labels, i)), none)
    line = lambda c: F.array_join(F.array_sort(F.array_distinct(c)), ",")
    return told.select(
        "doc_id",
        "n_words",
        F.size("at").cast("long").alias("n_base"),
        F.array_min("at").cast("long").alias("first_word"),
        F.array_max("at").cast("long").alias("last_word"),
        line(F.col("base")).alias("base_labels"),
        line(F.concat("base", extra)).alias("labels"),
        F.coalesce(score, F.when(F.size("base") > 0, 0.5), F.lit(0.0)).alias("score"),
        F.coalesce("kept.rules", F.array().cast("array<int>")).alias("rules"),
    )
