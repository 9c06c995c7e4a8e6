"""Licences are told from their neighbours."""

from quire.llm import licenses as L


def test_neighbours_are_told_apart(spark):
    gpl = L.TEMPLATES["gpl-3.0"][1]
    cases = {
        "Licensed under CC BY 4.0.": "cc-by-4.0", "Licensed under CC BY-SA 4.0.": "cc-by-sa-4.0", "Licensed under CC BY-NC 4.0.": "cc-by-nc-4.0",
        gpl: "gpl-3.0", L.TEMPLATES["gpl-2.0"][1]: "gpl-2.0", L.TEMPLATES["agpl-3.0"][1]: "agpl-3.0",
        "Released under the ISC License.": "isc", "SPDX-License-Identifier: MPL-2.0": "mpl-2.0",
        "Licensed under CC BY 3.0.": None, "Licensed under CC BY-NC-SA 4.0.": None, gpl.replace("version 3", "version 4"): None,
        "Released under the MIT License. Non-commercial use only.": None,
    }
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(cases)], "doc_id long, text string")
    plain = spark.createDataFrame([(k, f"an ordinary line {k} of a report\nand the next one") for k in range(40)], "doc_id long, text string")
    rows = {r.doc_id: r.family for r in L.scan(docs, L.train(plain)).where("confirmed").collect()}
    assert {t: rows.get(k) for k, t in enumerate(cases)} == cases


def test_changed_and_wrapped_licences(spark):
    """Templates that training never saw in this form: words lost or added, other case, wrapped over
    lines, between prose; and sentences and near licences as negatives. Recall and precision by paragraph."""
    import random
    import textwrap

    rng = random.Random(99)
    prose = ["The river runs under the old bridge.", "Nobody came to the market that day.", "He wrote a letter and sent it home."]
    rows, planted = [], {}
    for family, texts in L.TEMPLATES.items():
        for text in texts:
            for way in range(4):
                words = text.split()
                if way == 0 and len(words) > 14:
                    words.pop(rng.randrange(5, len(words) // 2))
                line = " ".join(words)
                if way == 1:
                    line = line.upper()
                if way == 2:
                    line = f"{rng.choice(['Note:', 'In', 'File', 'See'])} {line}"
                if way == 3 and len(words) > 8:
                    line = textwrap.fill(line, 40)
                planted[len(rows)] = family
                rows.append((len(rows), "\n".join([rng.choice(prose), line, rng.choice(prose)])))
    for text in [*L.NOT_LICENSES, *prose, "Licensed drivers may enter.", "The general public may use the library.", "All rights of way are reserved for trams."]:
        rows.append((len(rows), "\n".join([rng.choice(prose), text])))
    df = spark.createDataFrame([(*r, 1) for r in rows] + [(None, None, 1), (10**6, "", 1)], "doc_id long, text string, family int")
    scanner = L.train(df, max_paragraphs=50, max_docs=20)
    got = L.scan(df, scanner).collect()
    assert all((r.family == r.predicted) if r.confirmed else (r.family == "unknown" and not r.wrapped) for r in got)
    hits = {(r.doc_id, r.family) for r in got if r.family != "unknown"}
    right = sum((d, f) in hits for d, f in planted.items())
    assert right / len(planted) >= 0.9
    assert sum(planted.get(d) == f for d, f in hits) / len(hits) >= 0.9
    wrapped = {r.doc_id for r in got if r.wrapped}
    assert len(wrapped) >= 8 and all(planted[d] for d in wrapped)


def test_paragraphs_of_wrapped_lines(spark):
    text = "One line.\ntwo goes\non here.\n\nthree\n\nfour"
    got = [(r.paragraph, r.wrapped, r.text) for r in L.paragraphs(spark.createDataFrame([(1, text), (2, None), (3, " \n ")], "doc_id long, text string")).collect()]
    assert got == [(0, False, "One line."), (1, False, "two goes"), (2, False, "on here."), (4, False, "three"), (6, False, "four"), (1, True, "two goes on here.")]
