"""License scans: ordered signature rules over normalised words, in DataFrame functions only.

Texts are lower-cased (A-Z only) and split into words; rules match the words joined by single spaces. Rules are made
from hand-written license families, for each a name, grant, identifier and link signature, and written one by one for other
namings, sentences of license texts and terms of use: over four hundred regular expressions. Each rule has keywords, whole words of which each of its matches contains one at least; only
rules of which a text has a keyword are run on it. A match is kept unless another match contains it that is longer or of higher
priority, and at least of its priority, so that ``gnu lesser general public license`` isn't also a ``gpl`` find of the
method. The three base phrases always keep their labels.

Null and empty texts have no words, no labels and score 0. All matches of a text are scanned in one pass over their
order, however many there are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._tables import documents, whole

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
NOT_WORD = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
#: Fixed by the contract: phrase and label.
BASE = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))

#: label: (keywords with spaces between, expression of the name in normalised words, expression of the short identifier, link words)
FAMILIES = {
    "mit": ("mit", "mit", "mit", "opensource org licenses mit"),
    "mit-0": ("mit", "mit no attribution", "mit 0", "opensource org licenses mit 0"),
    "apache-1.1": ("apache", "apache software license( version)? 1 1", "apache 1 1", "apache org licenses license 1 1"),
    "apache-2.0": ("apache", "apache( software)? license( version)? 2( 0)?", "apache 2 0", "apache org licenses license 2 0"),
    "gpl-2": ("general", "(gnu )?general public license( as published by the free software foundation)?( either)? version 2", "gpl 2 0( only| or later)?", "gnu org licenses old licenses gpl 2 0"),
    "gpl-3": ("general", "(gnu )?general public license( as published by the free software foundation)?( either)? version 3", "gpl 3 0( only| or later)?", "gnu org licenses gpl 3 0"),
    "gpl": ("general", "(gnu )?general public license", "gpl", "gnu org licenses gpl"),
    "lgpl": ("lesser", "(gnu )?lesser general public license", "lgpl( 2 1| 3 0)?( only| or later)?", "gnu org licenses lgpl"),
    "lgpl-library": ("library", "(gnu )?library general public license", "lgpl 2 0", "gnu org licenses old licenses lgpl 2 0"),
    "agpl": ("affero", "(gnu )?affero general public license", "agpl( 3 0)?( only| or later)?", "gnu org licenses agpl"),
    "gfdl": ("documentation", "(gnu )?free documentation license", "gfdl( 1 [123])?", "gnu org licenses fdl"),
    "bsd-2": ("bsd freebsd", "(simplified bsd|bsd 2 clause|2 clause bsd|freebsd)( license)?", "bsd 2 clause", "opensource org licenses bsd 2 clause"),
    "bsd-3": ("bsd", "(new bsd|modified bsd|bsd 3 clause|3 clause bsd|revised bsd)( license)?", "bsd 3 clause", "opensource org licenses bsd 3 clause"),
    "bsd-4": ("bsd", "(original bsd|bsd 4 clause|4 clause bsd)( license)?", "bsd 4 clause", "spdx org licenses bsd 4 clause"),
    "0bsd": ("bsd", "(bsd zero clause|zero clause bsd)( license)?", "0bsd", "opensource org licenses 0bsd"),
    "isc": ("isc", "isc", "isc", "opensource org licenses isc"),
    "mpl-1.1": ("mozilla", "mozilla public license( version| v)? 1 1", "mpl 1 1", "mozilla org mpl 1 1"),
    "mpl-2.0": ("mozilla", "mozilla public license( version| v)? 2 0", "mpl 2 0", "mozilla org mpl 2 0"),
    "epl-1.0": ("eclipse", "eclipse public license( version| v)? 1 0", "epl 1 0", "eclipse org legal epl v10"),
    "epl-2.0": ("eclipse", "eclipse public license( version| v)? 2 0", "epl 2 0", "eclipse org legal epl 2 0"),
    "edl": ("eclipse", "eclipse distribution license", "edl 1 0", "eclipse org org documents edl v10"),
    "cddl": ("distribution", "common development and distribution license", "cddl 1 [01]", "opensource org licenses cddl1"),
    "cpl": ("common", "common public license", "cpl 1 0", "opensource org licenses cpl1 0"),
    "cc0": ("cc0", "cc0( 1 0)?( universal)?", "cc0 1 0", "creativecommons org publicdomain zero"),
    "cc-by": ("creative", "creative commons attribution( [1234] 0)?( international| unported)?", "cc by [1234] 0", "creativecommons org licenses by"),
    "cc-by-sa": ("creative", "creative commons attribution share ?alike", "cc by sa [1234] 0", "creativecommons org licenses by sa"),
    "cc-by-nc": ("creative", "creative commons attribution non ?commercial", "cc by nc [1234] 0", "creativecommons org licenses by nc"),
    "cc-by-nd": ("creative", "creative commons attribution no ?deriv(atives|s)?", "cc by nd [1234] 0", "creativecommons org licenses by nd"),
    "cc-by-nc-sa": ("creative", "creative commons attribution non ?commercial share ?alike", "cc by nc sa [1234] 0", "creativecommons org licenses by nc sa"),
    "unlicense": ("unlicense", "the unlicense", "unlicense", "unlicense org"),
    "wtfpl": ("wtfpl fuck", "do what the fuck you want to public license|wtfpl", "wtfpl", "wtfpl net"),
    "zlib": ("zlib", "zlib( libpng)?", "zlib", "opensource org licenses zlib"),
    "libpng": ("libpng", "libpng", "libpng( 2 0)?", "libpng org pub png src libpng license"),
    "boost": ("boost", "boost software license( version)?( 1 0)?", "bsl 1 0", "boost org license 1 0"),
    "artistic-1": ("artistic", "artistic license( version)? 1( 0)?", "artistic 1 0", "opensource org licenses artistic license 1 0"),
    "artistic-2": ("artistic", "artistic license( version)? 2( 0)?", "artistic 2 0", "opensource org licenses artistic license 2 0"),
    "python": ("python", "python( software foundation)? license( version 2)?", "python 2 0", "docs python org 3 license"),
    "psf": ("psf", "psf license( agreement)?", "psf 2 0", "python org psf license"),
    "php": ("php", "php license( version)?( 3 0 1)?", "php 3 0 1", "php net license"),
    "ruby": ("ruby", "ruby license", "ruby", "ruby lang org en about license"),
    "perl": ("perl", "same terms as perl( itself)?", "perl 5", "dev perl org licenses"),
    "openssl": ("openssl", "openssl license", "openssl", "openssl org source license"),
    "ssleay": ("ssleay", "(original )?ssleay license", "ssleay", "openssl org source ssleay"),
    "ofl": ("font", "(sil )?open font license( version)?( 1 1)?", "ofl 1 1", "scripts sil org ofl"),
    "eupl": ("european", "european union public license( version| v)?( 1 [012])?", "eupl 1 [012]", "joinup ec europa eu eupl"),
    "cecill": ("cecill", "cecill( b| c)?( free software)? license", "cecill( b| c)?( 2 1)?", "cecill info licences"),
    "upl": ("universal", "universal permissive license( version)?( 1 0)?", "upl 1 0", "oss oracle com licenses upl"),
    "ms-pl": ("microsoft", "microsoft public license", "ms pl", "opensource org licenses ms pl"),
    "ms-rl": ("microsoft", "microsoft reciprocal license", "ms rl", "opensource org licenses ms rl"),
    "ncsa": ("ncsa", "(university of illinois )?ncsa open source license", "ncsa", "opensource org licenses ncsa"),
    "postgresql": ("postgresql", "postgresql license", "postgresql", "postgresql org about licence"),
    "x11": ("x11", "x11", "x11", "xfree86 org license x11"),
    "w3c": ("w3c", "w3c software( notice and)? license", "w3c", "w3 org consortium legal copyright software"),
    "vim": ("vim", "vim license", "vim", "vimhelp org uganda license"),
    "afl": ("academic", "academic free license( version| v)?( [123] [01])?", "afl [123] [01]", "opensource org licenses afl"),
    "osl": ("open", "open software license( version| v)?( [123] 0)?", "osl [123] 0", "opensource org licenses osl"),
    "odbl": ("database", "open (data commons open )?database license", "odbl 1 0", "opendatacommons org licenses odbl"),
    "pddl": ("dedication", "public domain dedication and license", "pddl 1 0", "opendatacommons org licenses pddl"),
    "elastic": ("elastic", "elastic license( version)?( 2 0)?", "elastic 2 0", "elastic co licensing elastic license"),
    "sspl": ("server", "server side public license", "sspl 1 0", "mongodb com licensing server side public license"),
    "busl": ("business", "business source license( version)?( 1 1)?", "busl 1 1", "mariadb com bsl11"),
    "blueoak": ("oak", "blue oak model license( version)?( 1 0 0)?", "blueoak 1 0 0", "blueoakcouncil org license 1 0 0"),
    "mulan": ("mulan", "mulan( permissive software)? license", "mulanpsl 2 0", "license coscl org cn mulanpsl2"),
    "llama": ("llama", "llama [23]( [0-9])? community license", "llama [23]", "llama meta com license"),
    "rail": ("rail responsible", "(open )?rail( m)? license|responsible ai license", "openrail", "licenses ai blog openrail"),
}

#: Rules of no family: label, keywords, expression, priority.
SINGLE = (
    ("public-domain", "domain", "(released|placed|dedicated|is) (in|into|to) the public domain", 3),
    ("proprietary", "rights", "all rights reserved", 2),
    ("copyright", "copyright", "copyright( c)? (19|20)[0-9]{2}", 2),
    ("permission-notice", "permission", "permission is hereby granted free of charge to any person", 3),
    ("permission-notice", "permission", "permission to use copy modify and (or )?distribute this software", 3),
    ("warranty-disclaimer", "warranty", "without (any )?warranty( of any kind)?", 1),
    ("warranty-disclaimer", "provided", "(software )?is provided as is", 1),
    ("redistribution", "redistribution", "redistribution and use in source and binary forms", 3),
    ("free-software", "redistribute", "you can redistribute it and or modify it", 3),
    ("non-commercial", "commercial noncommercial", "(for )?non ?commercial use only", 2),
    ("confidential", "confidential", "confidential and proprietary", 2),
)
#: Rules for other ways of naming a license, for sentences of license texts and for terms of use: label, keywords,
#: expression, priority.
HAND = (
    ("gpl-3", "gplv3 gpl", "(gnu )?(gplv3|gpl v3|gpl version 3)( or later| only)?", 2),
    ("gpl-2", "gplv2 gpl", "(gnu )?(gplv2|gpl v2|gpl version 2)( or later| only)?", 2),
    ("gpl-1", "gplv1 gpl", "(gnu )?(gplv1|gpl v1|gpl version 1)", 2),
    ("gpl", "gpl", "(gnu )?gpl licen[sc]ed?", 2),
    ("gpl", "gpl", "(under|with) (the )?(gnu )?gpl", 2),
    ("gpl", "gpl", "gnu gpl", 1),
    ("gpl", "program", "this program is free software", 2),
    ("gpl", "hope", "distributed in the hope that it will be useful", 2),
    ("gpl", "received", "you should have received a copy of the gnu general public license", 4),
    ("lgpl-3", "lgplv3 lgpl", "(gnu )?(lgplv3|lgpl v3|lgpl version 3)( or later| only)?", 2),
    ("lgpl-2.1", "lgplv2 lgpl", "(gnu )?(lgplv2 1|lgpl v2 1|lgpl version 2 1)( or later| only)?", 2),
    ("lgpl", "lgpl", "(gnu )?lgpl( licen[sc]ed?)?", 1),
    ("lgpl", "library", "this library is free software", 2),
    ("lgpl", "received", "you should have received a copy of the gnu lesser general public license", 4),
    ("agpl-3", "agplv3 agpl", "(gnu )?(agplv3|agpl v3|agpl version 3)( or later| only)?", 2),
    ("agpl", "agpl", "(gnu )?agpl( licen[sc]ed?)?", 1),
    ("agpl", "remote", "remote network interaction", 2),
    ("apache-2.0", "apache", "apache( v| version)? 2 0( licen[sc]ed?)?", 2),
    ("apache-2.0", "apache apachev2 apache2", "(apache v2|apachev2|apache2)( licen[sc]ed?)?", 2),
    ("apache-2.0", "compliance", "you may not use this file except in compliance with the license", 4),
    ("apache-2.0", "perpetual", "perpetual worldwide non exclusive no charge royalty free irrevocable (copyright|patent) license", 3),
    ("apache", "apache", "apache licensed", 2),
    ("apache", "apache", "apache software foundation", 1),
    ("bsd", "bsd", "bsd licen[sc]ed?", 2),
    ("bsd", "bsd", "bsd (style|like|type) licen[sc]e", 2),
    ("bsd", "berkeley", "berkeley software distribution( licen[sc]e)?", 2),
    ("bsd", "retain", "redistributions of source code must retain the above copyright notice", 3),
    ("bsd", "reproduce", "redistributions in binary form must reproduce the above copyright notice", 3),
    ("bsd-3", "endorse", "to endorse or promote products derived from this software", 3),
    ("bsd-4", "advertising", "all advertising materials mentioning features or use of this software", 4),
    ("mit", "mit", "mit licensed", 2),
    ("mit", "mit", "mit (style|like|type) licen[sc]e", 2),
    ("mit", "expat", "expat licen[sc]e", 2),
    ("mit", "sublicense", "use copy modify merge publish distribute sublicense and or sell copies", 4),
    ("mit", "portions", "shall be included in all copies or substantial portions of the software", 4),
    ("isc", "fee", "for any purpose with or without fee is hereby granted", 4),
    ("mpl-2.0", "mplv2 mpl", "mplv2( 0)?|mpl v2( 0)?|mpl version 2 0", 2),
    ("mpl-1.1", "mplv1 mpl", "mplv1 1|mpl v1 1|mpl version 1 1", 2),
    ("mpl", "mpl", "mpl licen[sc]ed?", 1),
    ("mpl", "mozilla", "mozilla public licen[sc]e", 1),
    ("mpl-2.0", "mozilla", "source code form is subject to the terms of the mozilla public license", 4),
    ("epl", "eclipse", "eclipse public licen[sc]e", 1),
    ("epl-2.0", "eplv2 epl", "eplv2|epl v2( 0)?", 2),
    ("epl", "accompanying", "this program and the accompanying materials are made available under the terms", 3),
    ("cddl", "cddl", "cddl( licen[sc]ed?| v1 [01])", 2),
    ("cc-by", "cc", "cc by( licen[sc]ed?)?", 1),
    ("cc-by-sa", "cc", "cc by sa( licen[sc]ed?)?", 2),
    ("cc-by-nc", "cc", "cc by nc( licen[sc]ed?)?", 2),
    ("cc-by-nd", "cc", "cc by nd( licen[sc]ed?)?", 2),
    ("cc-by-nc-sa", "cc", "cc by nc sa( licen[sc]ed?)?", 3),
    ("cc-by-nc-nd", "cc", "cc by nc nd( licen[sc]ed?)?", 3),
    ("cc-by-nc-nd", "creative", "creative commons attribution non ?commercial no ?deriv(atives|s)?", 3),
    ("cc", "creative", "creative commons licen[sc]ed?", 1),
    ("cc0", "creative", "creative commons zero", 2),
    ("cc0", "waived", "has waived all copyright and related or neighboring rights", 4),
    ("public-domain", "unencumbered", "free and unencumbered software released into the public domain", 4),
    ("public-domain", "dedication", "public domain dedication", 2),
    ("public-domain", "dedicates dedicate", "dedicates? (this work|it) to the public domain", 3),
    ("public-domain", "copyright", "no (known )?copyright( restrictions)?", 2),
    ("ofl", "font", "with reserved font names?", 2),
    ("zlib", "altered", "altered source versions must be plainly marked as such", 3),
    ("zlib", "misrepresented", "the origin of this software must not be misrepresented", 3),
    ("boost", "boost", "boost licen[sc]ed?", 2),
    ("boost", "executable", "machine executable object code generated by a source language processor", 3),
    ("artistic", "artistic", "(perl )?artistic licen[sc]e", 1),
    ("python", "python", "(19|20)[0-9]{2} python software foundation", 3),
    ("json", "evil", "shall be used for good not evil", 4),
    ("beerware", "beerware beer", "beerware|beer ware licen[sc]e", 2),
    ("hippocratic", "hippocratic", "hippocratic licen[sc]e( 2 1| 3 0)?", 2),
    ("anti-996", "996", "anti 996 licen[sc]e", 2),
    ("ecl-2.0", "community", "educational community licen[sc]e( version)?( 2 0)?", 2),
    ("qpl", "q", "q public licen[sc]e", 2),
    ("sleepycat", "sleepycat", "sleepycat( public)? licen[sc]e", 2),
    ("ijg", "jpeg", "independent jpeg group( s software)?", 2),
    ("icu", "icu", "icu licen[sc]e", 2),
    ("unicode", "unicode", "unicode( data files)? licen[sc]e( agreement)?", 2),
    ("curl", "curl", "curl licen[sc]e", 2),
    ("ntp", "ntp", "ntp licen[sc]e", 2),
    ("hpnd", "historical", "historical permission notice and disclaimer", 3),
    ("tcl", "tcl", "tcl( tk)? licen[sc]e", 2),
    ("wxwindows", "wxwindows", "wxwindows( library)? licen[sc]e", 2),
    ("intel", "intel", "intel( open source| simplified software)? licen[sc]e", 2),
    ("nvidia", "nvidia", "nvidia( source code| software)? licen[sc]e", 2),
    ("gemma", "gemma", "gemma terms of use", 2),
    ("falcon", "falcon", "falcon( llm)? licen[sc]e", 2),
    ("bigscience-rail", "bigscience", "bigscience( bloom)? rail( licen[sc]e)?", 3),
    ("creativeml-rail", "creativeml", "creativeml open ?rail( m)?( licen[sc]e)?", 3),
    ("mistral", "mistral", "mistral( ai)?( research| non production) licen[sc]e", 2),
    ("polyform", "polyform", "polyform (noncommercial|small business|shield|strict|perimeter|free trial)( licen[sc]e)?", 2),
    ("commons-clause", "clause", "commons clause( licen[sc]e)?( condition)?", 2),
    ("parity", "parity", "parity public licen[sc]e", 2),
    ("prosperity", "prosperity", "prosperity public licen[sc]e", 2),
    ("rpl", "reciprocal", "reciprocal public licen[sc]e( 1 5)?", 2),
    ("apsl", "apple", "apple public source licen[sc]e( 2 0)?", 2),
    ("ibm-pl", "ibm", "ibm public licen[sc]e", 2),
    ("lppl", "latex lppl", "latex project public licen[sc]e|lppl( 1 3c?)?", 2),
    ("nasa", "nasa", "nasa open source agreement", 2),
    ("sgi-b", "sgi", "sgi free software licen[sc]e b", 2),
    ("sun-pl", "sun", "sun public licen[sc]e", 2),
    ("sissl", "sun", "sun industry standards source licen[sc]e", 2),
    ("vovida", "vovida", "vovida software licen[sc]e", 2),
    ("zpl", "zope", "zope public licen[sc]e( 2 [01])?", 2),
    ("watcom", "watcom", "(sybase )?open watcom public licen[sc]e", 2),
    ("nokia", "nokia", "nokia open source licen[sc]e", 2),
    ("miros", "miros", "miros licen[sc]e", 2),
    ("lucent", "lucent", "lucent public licen[sc]e( 1 02)?", 2),
    ("frameworx", "frameworx", "frameworx( open)? licen[sc]e", 2),
    ("eiffel", "eiffel", "eiffel forum licen[sc]e( 2)?", 2),
    ("fair", "fair", "fair licen[sc]e", 2),
    ("attribution-assurance", "assurance", "attribution assurance licen[sc]e", 2),
    ("openldap", "openldap", "openldap public licen[sc]e( 2 8)?", 2),
    ("open-publication", "publication", "open publication licen[sc]e", 2),
    ("cern-ohl", "cern", "cern open hardware licen[sc]e( version 2)?", 2),
    ("ogl", "government", "open government licen[sc]e( v[123])?", 2),
    ("odc-by", "commons", "open data commons attribution licen[sc]e", 3),
    ("etalab", "etalab", "etalab( open)? licen[sc]e", 2),
    ("dual", "dual", "dual licensed( under)?", 2),
    ("dual", "either", "licensed under either of", 2),
    ("copyleft", "copyleft", "(strong |weak )?copyleft( licen[sc]e)?", 1),
    ("proprietary", "proprietary", "proprietary (licen[sc]e|software|information)", 2),
    ("proprietary", "unpublished", "unpublished (proprietary )?source code", 2),
    ("proprietary", "agreement", "end user licen[sc]e agreement", 3),
    ("proprietary", "eula", "eula", 1),
    ("proprietary", "reverse", "may not reverse engineer( decompile or disassemble)?", 3),
    ("proprietary", "permission", "without (the )?(prior |express )?(written )?permission", 2),
    ("evaluation", "evaluation", "for evaluation( purposes)? only", 2),
    ("trial", "trial", "(free )?trial version( only)?", 1),
    ("commercial", "commercial", "commercial licen[sc]e( required| available)?", 2),
    ("shareware", "shareware", "shareware", 1),
    ("freeware", "freeware", "freeware", 1),
    ("non-commercial", "noncommercial non", "(for )?non ?commercial (research|educational|academic|personal) (use|purposes)( only)?", 3),
    ("research-only", "research", "(for )?research (use|purposes) only", 2),
    ("academic-only", "academic", "(for )?academic (use|purposes) only", 2),
    ("personal-only", "personal", "(for )?personal use only", 2),
    ("educational-only", "educational", "(for )?educational (use|purposes) only", 2),
    ("internal-only", "internal", "(for )?internal use only", 2),
    ("no-derivatives", "derivative derivatives", "no derivative works|no derivatives allowed", 2),
    ("no-redistribution", "redistribution", "redistribution (is )?(prohibited|not (allowed|permitted))", 2),
    ("no-redistribution", "redistributed", "may not be redistributed", 2),
    ("no-training", "training", "may not be used (for|in) (the )?training( of)? (machine learning|language|ai) models", 3),
    ("attribution", "attribution", "attribution (is )?required", 2),
    ("warranty-disclaimer", "merchantability", "(implied )?warrant(y|ies) of merchantability", 1),
    ("warranty-disclaimer", "fitness", "fitness for a particular purpose", 1),
    ("warranty-disclaimer", "express", "without (any )?express or implied warranty", 1),
    ("liability-disclaimer", "liable", "in no event shall (the )?(authors?|copyright holders?|contributors?|company) be liable", 2),
    ("liability-disclaimer", "liable", "liable for any (claim|damages|loss)", 1),
    ("patent-grant", "patent", "patent licen[sc]e( grant)?", 1),
    ("trademark", "trademark trademarks", "(registered )?trademarks? of", 1),
    ("export-control", "export", "export (control|administration) (laws|regulations)", 1),
)
LEVELS = 5
#: Matches of a rule whose places are summed in one fold.
BLOCK = 64


def rules() -> list[tuple[int, str, list[str], str, int]]:
    """(id, label, keywords, expression, priority): base phrases first, then the families', then single ones."""
    out = [(label, phrase.split()[0], phrase, 1) for phrase, label in BASE]
    for label, (keywords, name, short, link) in FAMILIES.items():
        licensed = name if "licen" in name else f"({name}) licen[sc]e"
        out += [
            (label, keywords, licensed, 2),
            (label, "licensed", f"licensed under (the )?({licensed}|{name})", 3),
            (label, "spdx", f"spdx license identifier ({short})", 4),
            (label, link.split()[0], f"{link}", 3),
        ]
    out += [*SINGLE, *HAND]
    return [(i, label, keywords.split(), f"(?<![^ ])(?:{expression})(?![^ ])", level) for i, (label, keywords, expression, level) in enumerate(out)]


def _rule_array(table) -> Column:
    row = "named_struct('id', {}, 'label', '{}', 'keywords', array({}), 'pattern', '{}', 'level', {})"
    return F.expr("array(" + ",".join(row.format(i, a, ", ".join(f"'{k}'" for k in ks), p.replace("\\", "\\\\"), v) for i, a, ks, p, v in table) + ")")


def normalised(df: DataFrame, text: str = "text", to: str = "words") -> DataFrame:
    low = F.translate(whole(F.col(text)), UPPER, UPPER.lower())
    return df.withColumn(to, F.array_remove(F.split(low, NOT_WORD), ""))


def _matches(line: Column, rule: Column) -> Column:
    """Structs of start and end (code points) of each match of the rule in line."""
    found = F.regexp_extract_all(line, rule["pattern"], F.lit(0))
    parts = F.split(line, rule["pattern"], F.lit(-1))
    zipped = F.arrays_zip(F.slice(parts, F.lit(1), F.size(found)).alias("gap"), found.alias("found"))
    steps = F.transform(zipped, lambda x: F.struct(F.length(x["gap"]).alias("gap"), F.length(x["found"]).alias("size")))
    row = "struct<start:int,end:int,id:int,level:int,label:string>"
    zero = lambda kind: F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{kind}>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        begin = acc["at"] + x["gap"]
        end = begin + x["size"]
        match = F.struct(begin.alias("start"), end.alias("end"), rule["id"].alias("id"), rule["level"].alias("level"), rule["label"].alias("label"))
        return F.struct(end.alias("at"), F.array_append(acc["out"], match).alias("out"))

    def shift(acc: Column, block: Column) -> Column:
        moved = F.transform(block["out"], lambda m: F.struct((m["start"] + acc["at"]).alias("start"), (m["end"] + acc["at"]).alias("end"), m["id"], m["level"], m["label"]))
        return F.struct((acc["at"] + block["at"]).alias("at"), F.array_append(acc["out"], moved).alias("out"))

    def places(steps: Column) -> Column:
        """Appending copies, so places are summed in blocks and the blocks then moved by what comes before them."""
        last = F.floor(F.greatest(F.size(steps) - 1, F.lit(0)) / BLOCK).cast("int")
        blocks = F.transform(F.sequence(F.lit(0), last), lambda k: F.aggregate(F.slice(steps, k * BLOCK + 1, F.lit(BLOCK)), zero(row), step))
        return F.aggregate(blocks, zero(f"array<{row}>"), shift, lambda acc: F.flatten(acc["out"]))

    return F.element_at(F.transform(F.array(steps), places), 1)  # steps is bound once, not found again for each block


def scan(df: DataFrame, text: str = "text", table=None) -> DataFrame:
    """The operator: df with ``words`` and ``finds``, an array of (start, end in code points of the joined words, rule
    id, level, label) sorted by start, longest and highest first. Rules run only where one of their keywords is a word."""
    table = table or rules()
    keywords = sorted({k for _, _, ks, _, _ in table for k in ks})
    df = normalised(df, text)
    df = df.withColumn("hits", F.array_intersect(F.col("words"), F.array(*[F.lit(k) for k in keywords])))
    df = df.withColumn("line", F.when(F.size("hits") > 0, F.array_join("words", " ")))
    due = F.filter(_rule_array(table), lambda r: F.arrays_overlap(F.col("hits"), r["keywords"]))
    finds = F.flatten(F.transform(due, lambda r: _matches(F.col("line"), r)))
    none = F.array().cast("array<struct<start:int,end:int,id:int,level:int,label:string>>")
    ordered = F.transform(
        F.sort_array(F.transform(finds, lambda x: F.struct(x["start"].alias("start"), (-x["end"]).alias("back"), (-x["level"]).alias("low"), x["id"].alias("id"), x["label"].alias("label")))),
        lambda x: F.struct(x["start"].alias("start"), (-x["back"]).alias("end"), x["id"].alias("id"), (-x["low"]).alias("level"), x["label"].alias("label")),
    )
    return df.withColumn("finds", F.when(F.size("hits") > 0, ordered).otherwise(none)).drop("hits")


def resolve(finds: Column) -> Column:
    """Struct of ``labels`` (those with a find that no other suppresses) and ``best`` (highest level kept, else 0)."""
    levels = range(1, LEVELS)
    zero = F.struct(*[F.lit(-1).alias(f"end{v}") for v in levels], F.array().cast("array<string>").alias("labels"), F.lit(0).alias("best"))

    def step(acc: Column, x: Column) -> Column:
        # what comes earlier starts no later; it contains x if it ends no earlier
        inside = F.lit(False)
        for v in levels:
            inside = inside | ((x["level"] <= v) & (acc[f"end{v}"] >= x["end"]))
        ends = [F.when(~inside & (x["level"] == v), F.greatest(acc[f"end{v}"], x["end"])).otherwise(acc[f"end{v}"]).alias(f"end{v}") for v in levels]
        labels = F.when(inside, acc["labels"]).otherwise(F.array_union(acc["labels"], F.array(x["label"])))
        return F.struct(*ends, labels.alias("labels"), F.when(inside, acc["best"]).otherwise(F.greatest(acc["best"], x["level"])).alias("best"))

    return F.aggregate(finds, zero, step, lambda acc: F.struct(acc["labels"].alias("labels"), acc["best"].alias("best")))


def op3(docs: DataFrame) -> DataFrame:
    df = scan(docs.select("doc_id", F.col("text"))).drop("text")
    base = F.filter("finds", lambda x: x["id"] < len(BASE))
    df = df.withColumn("base", base).withColumn("kept", resolve(F.col("finds")))
    spaces = lambda at: (F.length(F.substring(F.col("line"), F.lit(1), at)) - F.length(F.replace(F.substring(F.col("line"), F.lit(1), at), F.lit(" "), F.lit("")))).cast("bigint")
    some = F.size("base") > 0
    base_labels = F.array_sort(F.array_distinct(F.transform("base", lambda x: x["label"])))
    return df.select(
        "doc_id",
        F.size("words").cast("bigint").alias("n_words"),
        F.size("base").cast("bigint").alias("n_base"),
        F.when(some, spaces(F.element_at(F.col("base"), 1)["start"])).alias("first_word"),
        F.when(some, spaces(F.element_at(F.col("base"), -1)["start"])).alias("last_word"),
        F.array_join(base_labels, ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union(base_labels, F.col("kept.labels"))), ",").alias("labels"),
        (F.col("kept.best") / (LEVELS - 1)).alias("score"),
    )


def query(spark, sf_dir: str) -> DataFrame:
    return op3(documents(spark, sf_dir))


