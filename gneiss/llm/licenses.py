"""Licence recognition by sentence rules, in DataFrame functions alone.

Each text is cut into sentences, on one line or wrapped over several, the
sentences are normalised (letters, digits and inner dots, one space between
words, lower case), looked up among known licence sentences, and the sequence of
identifiers that comes out is matched against ordered rules; a rule gives way
where it lies within a longer rule that matches. The oracle SQL knows one-line
sentences of ``SENTENCES`` only and is for tables that hold no others.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gneiss.llm.common import table

# Normalised sentences of public licences and notices.
SENTENCES = {
    1: "licensed under the apache license version 2.0",
    2: "released under the mit license",
    3: "this work is licensed under the gnu general public license version 3",
    4: "licensed under cc by nc 4.0",
    5: "licensed under the mit license",
    6: "you may not use this file except in compliance with the license",
    7: "you may obtain a copy of the license at http www.apache.org licenses license 2.0",
    8: "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied",
    9: "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction",
    10: "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    11: "the software is provided as is without warranty of any kind express or implied",
    12: "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    13: "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
    14: "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
    15: "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    16: "licensed under cc by 4.0",
    17: "licensed under cc by sa 4.0",
    18: "all rights reserved",
}
#: Rule, class, ordered identifiers; they follow each other among the recognised sentences.
RULES = [
    ("apache-2.0", "permissive", (1,)),
    ("apache-2.0-notice", "permissive", (1, 6, 7, 8)),
    ("apache-2.0-notice-short", "permissive", (1, 6, 8)),
    ("mit", "permissive", (2,)),
    ("mit-named", "permissive", (5,)),
    ("mit-text", "permissive", (9, 10, 11)),
    ("bsd-2-clause", "permissive", (12, 13, 14)),
    ("bsd-3-clause", "permissive", (12, 13, 14, 15)),
    ("gpl-3.0", "copyleft", (3,)),
    ("cc-by-nc-4.0", "noncommercial", (4,)),
    ("cc-by-4.0", "permissive", (16,)),
    ("cc-by-sa-4.0", "copyleft", (17,)),
    ("proprietary", "proprietary", (18,)),
]
_GNU = "you can redistribute it and or modify it under the terms of the gnu {}general public license as published by the free software foundation {}version {} of the license{}"
_LATER = " or at your option any later version"
#: The published wordings that differ from ``SENTENCES``, and the identifiers they
#: stand for; * is a name of up to twelve words.
VARIANTS = {
    "licensed under the apache license version 2.0 the license": (1,),
    "the asf licenses this file to you under the apache license version 2.0 the license": (1,),
    **{f"you may obtain a copy of the license at {http} www.apache.org licenses license 2.0": (7,) for http in ("http", "https")},
    # On one line nothing ends the sentence after the address.
    **{f"you may obtain a copy of the license at {http} www.apache.org licenses license 2.0 {SENTENCES[8]}": (7, 8) for http in ("http", "https")},
    SENTENCES[9] + " including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions": (9,),
    SENTENCES[10].replace("permission notice", "permission notice including the next paragraph"): (10,),
    **{f"{SENTENCES[11]} including but not limited to the warranties of merchantability fitness for a particular purpose and {non}": (11,) for non in ("noninfringement", "non infringement")},
    SENTENCES[15].replace("the copyright holder", "*"): (15,),
    SENTENCES[15].replace("the copyright holder", "*").replace("its contributors", "contributors"): (15,),
    "the name of the author may not be used to endorse or promote products derived from this software without specific prior written permission": (15,),
    **{_GNU.format("", either, 3, later): (3,) for either in ("either ", "") for later in (_LATER, "")},
    **{_GNU.format("", either, 2, later): (19,) for either in ("either ", "") for later in (_LATER, "")},
    **{_GNU.format("lesser ", either, v, later): (20,) for either in ("either ", "") for v in (2.1, 3) for later in (_LATER, "")},
    **{_GNU.format("affero ", either, 3, later): (21,) for either in ("either ", "") for later in (_LATER, "")},
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies": (22,),
    "permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies": (22,),
    # The full stop of "v. 2.0" ends a sentence.
    "this source code form is subject to the terms of the mozilla public license v": (23,),
    **{f"if a copy of the mpl was not distributed with this file you can obtain one at {http} mozilla.org mpl 2.0": (24,) for http in ("http", "https")},
    "this is free and unencumbered software released into the public domain": (25,),
    "this software is provided as is without any express or implied warranty": (26,),
    "in no event will the authors be held liable for any damages arising from the use of this software": (27,),
    "distributed under the boost software license version 1.0": (28,),
    **{f"this work is licensed under {a} creative commons attribution 4.0 international license": (16,) for a in ("the", "a")},
    **{f"this work is licensed under {a} creative commons attribution sharealike 4.0 international license": (17,) for a in ("the", "a")},
    **{f"this work is licensed under {a} creative commons attribution noncommercial 4.0 international license": (4,) for a in ("the", "a")},
}
#: Further sequences: of the published notices, "all rights reserved" is a part.
MORE_RULES = [
    ("mit-text", "permissive", (18, 9, 10, 11)),
    ("bsd-2-clause", "permissive", (18, 12, 13, 14)),
    ("bsd-3-clause", "permissive", (18, 12, 13, 14, 15)),
    ("gpl-2.0", "copyleft", (19,)),
    ("lgpl", "copyleft", (20,)),
    ("agpl-3.0", "copyleft", (21,)),
    ("isc", "permissive", (22,)),
    ("mpl-2.0", "copyleft", (23, 24)),
    ("unlicense", "permissive", (25,)),
    ("zlib", "permissive", (26, 27)),
    ("bsl-1.0", "permissive", (28,)),
]
_CUT, _NOISE, _EDGE = r"[.!?;:]+[ \t\r]+|[.!?;:]*\n+|[.!?;:]+$", r"[^A-Za-z0-9.\x01]+", r" ?\x01 ?"


def _key(ids: tuple[int, ...]) -> str:
    """Each identifier between commas of its own, so that neighbours share none."""
    return "".join(f",{i}," for i in ids)


def _covered(rules=RULES) -> list[tuple[str, str, str, list[str]]]:
    """Name, class, key, and keys of the longer rules that contain the rule."""
    return [(name, kind, _key(ids), [_key(o) for _, _, o in rules if len(o) > len(ids) and _key(ids) in _key(o)]) for name, kind, ids in rules]


# Line ends (\x02) end a sentence as \x01 does, or stand between two of its words.
_HARD, _KEPT = r"[.!?;:]+[ \t\r]+|[.!?;:]+\n+|[.!?;:]+$", r"[^A-Za-z0-9.\x01\x02]+"
_GAP, _ANY = r"[ \x02]+", r"(?:[^ \x01\x02]+[ \x02]+){1,12}?"


def _wording(sentence: str) -> str:
    return _GAP.join(w.replace(".", "[.]") for w in sentence.split(" ")).replace("*" + _GAP, _ANY)


def _known() -> str:
    """The pattern of a known sentence between sentence ends, after a list number or not."""
    # The longest first: a wording may begin with another.
    every = sorted({*SENTENCES.values(), *VARIANTS}, key=len, reverse=True)
    return rf"(?:^|[\x01\x02]) ?(?:[0-9] )?({'|'.join(map(_wording, every))})(?= ?(?:[\x01\x02]|$))"


def recognise(docs: DataFrame) -> DataFrame:
    """doc_id, n_sentences, sentence_ids, licenses, license_class, one row per row.

    n_sentences counts sentences that keep a letter or digit, where every line
    ends one; sentence_ids are the recognised ones in text order, comma-separated,
    on one line or wrapped over several; licenses the matching rules' names in
    the order of ``RULES`` and ``MORE_RULES``, and license_class their classes,
    sorted and distinct. Nothing recognised, a null or an empty text: empty
    strings. Repeated sentences and rows count each; words of any length and
    texts of any length are read whole.
    """
    text = F.translate(F.coalesce("text", F.lit("")), "\x02", " ")
    marked = F.regexp_replace(F.regexp_replace(text, F.lit(_HARD), F.lit("\x01")), F.lit(r"\n+"), F.lit("\x02"))
    plain = F.lower(F.regexp_replace(marked, F.lit(_KEPT), F.lit(" ")))
    ids = {**{s: (k,) for k, s in SENTENCES.items()}, **VARIANTS}
    known = F.create_map(*[F.lit(x) for s, k in ids.items() for x in (s, ",".join(map(str, k)))])

    def wording(s):
        s = F.regexp_replace(s, F.lit(_GAP), F.lit(" "))
        return F.regexp_replace(s, F.lit("^(neither the name of ).*( nor the names of )"), F.lit("$1*$2"))

    rows = docs.select("doc_id", plain.alias("plain"))
    rows = rows.select("doc_id", F.size(F.filter(F.split("plain", r"[\x01\x02]"), lambda s: s.rlike("[a-z0-9]"))).cast("long").alias("n_sentences"), F.transform(F.regexp_extract_all("plain", F.lit(_known()), 1), wording).alias("hits"))
    rows = rows.withColumn("sentence_ids", F.array_join(F.transform("hits", lambda s: F.element_at(known, s)), ","))
    seq = F.concat(F.lit(","), F.replace("sentence_ids", F.lit(","), F.lit(",,")), F.lit(","))
    names, kinds = {}, []
    for name, kind, key, longer in _covered(RULES + MORE_RULES):
        # A shorter rule stands if it also occurs outside the longer ones.
        rest = seq
        for o in longer:
            rest = F.replace(rest, F.lit(o), F.lit(",0,"))
        hit = F.contains(rest, F.lit(key))
        names[name] = names[name] | hit if name in names else hit
        kinds.append(F.when(hit, F.lit(kind)))
    return rows.select("doc_id", "n_sentences", "sentence_ids", F.array_join(F.array_compact(F.array(*[F.when(hit, F.lit(name)) for name, hit in names.items()])), ",").alias("licenses"), F.array_join(F.array_sort(F.array_distinct(F.array_compact(F.array(*kinds)))), ",").alias("license_class"))


def op5_sentence_rules(spark, sf_dir: str) -> DataFrame:
    return recognise(table(spark, sf_dir, "documents").select("doc_id", "text"))


def _sql() -> str:
    """By lists: a rule matches where its identifiers stand in a row, unless a
    longer rule's row, of which they are a part, lies there."""
    sentences = ", ".join(f"({k}, '{s}')" for k, s in SENTENCES.items())
    rules = ", ".join(f"({place}, '{name}', '{kind}', {list(ids)})" for place, (name, kind, ids) in enumerate(RULES))
    cut, noise, edge = (x.replace("\\x01", "' || chr(1) || '") for x in (_CUT, _NOISE, _EDGE))
    return f"""
with k(id, sentence) as (values {sentences}), rules(place, name, kind, ids) as (values {rules}),
p as (select row_number() over () as rid, doc_id, [trim(s) for s in regexp_split_to_array(lower(regexp_replace(regexp_replace(coalesce(text, ''), '{cut}', chr(1), 'g'), '{noise}', ' ', 'g')), '{edge}')] as parts from documents),
w as (select rid, unnest(parts) as sentence, generate_subscripts(parts, 1) as i from p),
h as (select rid, list(id order by i) as found from w join k using (sentence) group by rid),
occurs as (select rid, r.place, r.name, r.kind, r.ids, unnest([i for i in range(1, len(found) - len(r.ids) + 2) if found[i : i + len(r.ids) - 1] = r.ids]) as start from h, rules r),
free as (select distinct rid, place, name, kind from occurs a where not exists (select 1 from occurs b where b.rid = a.rid and len(b.ids) > len(a.ids)
  and b.start <= a.start and a.start + len(a.ids) <= b.start + len(b.ids))),
m as (select rid, string_agg(name, ',' order by place) as licenses, array_to_string(list_sort(list(distinct kind)), ',') as license_class from free group by rid)
select doc_id, len([s for s in parts if regexp_matches(s, '[a-z0-9]')])::bigint as n_sentences,
  coalesce(array_to_string(found, ','), '') as sentence_ids, coalesce(licenses, '') as licenses, coalesce(license_class, '') as license_class
from p left join h using (rid) left join m using (rid)"""


ORACLE = {"op5_sentence_rules": _sql()}
