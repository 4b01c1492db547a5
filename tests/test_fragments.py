import random
import re

from lodestone.operators import fragments as G

SCHEMA = "doc_id long, n int, p string"


def joined(spark, *docs):
    df = spark.createDataFrame([(k, n, p) for k, d in enumerate(docs) for n, p in enumerate(d)], SCHEMA)
    out = {}
    for r in G.joined_fragments(df).orderBy("doc_id", "n").collect():
        out.setdefault(r.doc_id, []).append(r.p)
    return [out.get(k, []) for k in range(len(docs))]


def test_joined_fragments(spark):
    cases = [
        (["ARTÍCULO", "12.- Texto.", "más"], ["ARTÍCULO 12.- Texto.", "más"]),
        (["Artículo", "64", "bis.—Obligación de informar."], ["Artículo 64 bis.—Obligación de informar."]),
        (["Artículo 64", "bis.—Obligación.", "x"], ["Artículo 64 bis.—Obligación.", "x"]),
        (["Artículo 64.- Algo", "bis no"], ["Artículo 64.- Algo", "bis no"]),
        (["CAPÍTULO", "II", "De los sujetos", "Artículo 1.- x"], ["CAPÍTULO II De los sujetos", "Artículo 1.- x"]),
        (["CAPÍTULO I", "TRABAJADORES INDEPENDIENTES", "ARTÍCULO 1.- x"], ["CAPÍTULO I TRABAJADORES INDEPENDIENTES", "ARTÍCULO 1.- x"]),
        (["CAPÍTULO I", "De los saldos a favor y reembolsos del", "impuesto", "TÍTULO II"], ["CAPÍTULO I De los saldos a favor y reembolsos del impuesto", "TÍTULO II"]),
        (["CAPÍTULO I", "De los saldos del", "TÍTULO II"], ["CAPÍTULO I", "De los saldos del", "TÍTULO II"]),
        (["CAPÍTULO I", "Esto es prosa; sigue.", "Artículo 1.- x"], ["CAPÍTULO I", "Esto es prosa; sigue.", "Artículo 1.- x"]),
        (["TÍTULO I", "Disposiciones", "DECRETA", "Artículo 1.- x"], ["TÍTULO I", "Disposiciones", "DECRETA", "Artículo 1.- x"]),
        (["TÍTULO I", *(f"Línea {k}" for k in range(7)), "Artículo 1.- x"], ["TÍTULO I", *(f"Línea {k}" for k in range(7)), "Artículo 1.- x"]),
        (["TÍTULO I", *("Línea corta" for _ in range(6)), "Artículo 1.- x"], ["TÍTULO I " + " ".join(["Línea corta"] * 6), "Artículo 1.- x"]),
        (["SECCIÓN", "Primera parte", "x"], ["SECCIÓN", "Primera parte", "x"]),
        (["Transitorio", "IV.- Texto"], ["Transitorio IV.- Texto"]),
        (["ARTÍCULO"], ["ARTÍCULO"]),
        ([], []),
        (["", "x", None], ["", "x", ""]),
    ]
    assert joined(spark, *(c for c, _ in cases)) == [w for _, w in cases]


def plain_questions(paragraphs):
    """The rules as a walk through the paragraphs."""
    find, page = re.compile(G.QUESTION), re.compile(G.PAGE_NUMBER)

    def section_of(t):
        t = page.sub("", t).strip()
        return None if not t or len(t.split()) > 12 or re.search("[.!?¿:;]", t) else G.SECTION_NAMES.get(t, t)

    out, section, number, body = [], None, None, []

    def flush():
        if number is not None and section is not None:
            out.append((section, number, " ".join(body).strip()))

    for k, raw in enumerate(p.strip() for p in paragraphs):
        if not raw:
            continue
        ahead = find.search(paragraphs[k + 1].strip()) if k + 1 < len(paragraphs) else None
        here = find.search(raw)
        if here:
            name = section_of(raw[: here.start()].strip())
            if name:
                flush()
                section = name
            elif section is None:
                continue
            else:
                flush()
            number, body = int(here[1]), [raw[here.start() :].strip()]
        elif section_of(raw) and ahead and (number is None or ahead[1] == "1"):
            flush()
            section, number, body = section_of(raw), None, []
        elif section and number is not None and re.match(G.UNNUMBERED, raw) and ahead and int(ahead[1]) == number + 2:
            flush()
            number, body = number + 1, [raw]
        elif number is not None:
            body.append(page.sub("", raw).strip())
    flush()
    return out


def test_questions_against_a_walk(spark):
    rng = random.Random(1)
    docs = [["1. ¿Índice?", "2. ¿Más?", "Pagos", "1. ¿Cómo pago?", "Así.", "2. Si debo, ¿qué hago?", "12 nada", "¿Y otra cosa?", "4. ¿Fin?", "a.", "Declaraciones y Pagos", "1. ¿Quién?", "nadie"]]
    for _ in range(120):
        at, d = 0, []
        for _ in range(rng.randint(0, 14)):
            at = rng.choice([at + 1, at + 1, at + 2, 1])
            d.append(rng.choice([f"{at}. ¿Qué {at}?", f"{at}. Si a, ¿b?", "Una sección", "7 Otra sección", "Trámites 5. ¿Cuál?", "¿Sin número?", "respuesta. larga", "3 respuesta; b", "", "palabra", f"3 Sección {at}. ¿x?"]))
        docs.append(d)
    df = spark.createDataFrame([(k, n, p) for k, d in enumerate(docs) for n, p in enumerate(d)], SCHEMA)
    got = {}
    for r in G.question_chunks(df).orderBy("doc_id", "chunk").collect():
        got.setdefault(r.doc_id, []).append((r.section, r.number, r.body))
    for k, d in enumerate(docs):
        assert got.get(k, []) == plain_questions(d), d
    few = G.too_few_questions(spark.range(len(docs)).withColumnRenamed("id", "doc_id"), G.question_chunks(df), 2)
    assert {r.doc_id for r in few.collect()} == {k for k, d in enumerate(docs) if len(plain_questions(d)) < 2}
