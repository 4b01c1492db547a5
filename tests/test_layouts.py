import random
import re

from lodestone.operators import layouts as Y

SCHEMA = "doc_id long, n int, line string"


def wrapped(spark, *docs):
    lines = spark.createDataFrame([(k, n, x) for k, d in enumerate(docs) for n, x in enumerate(d)], SCHEMA)
    fixed = Y.wrapped_rows(lines)
    out = {}
    for r in fixed.orderBy("doc_id", "n").collect():
        out.setdefault(r.doc_id, []).append(r.line)
    return [out.get(k, []) for k in range(len(docs))], {r.doc_id for r in Y.without_wrapped_rows(lines, fixed).collect()}


def plain_wrapped(lines):
    """The rule as a walk, cells by their places."""

    def cells(x):
        return [(m.start(), m.end(), m[0]) for m in re.finditer(r"\S.*?(?= {3,}|$)", x.rstrip())]

    out, i = [], 0
    while i < len(lines):
        row, rest = cells(lines[i]), cells(lines[i + 2]) if i + 2 < len(lines) else []
        below = lines[i + 3].strip() if i + 3 < len(lines) else ""
        if len(row) == 2 and len(rest) == 1 and not lines[i + 1].strip() and not below and row[0][0] < rest[0][0] and rest[0][1] < row[1][0]:
            joined = f"{row[0][2]} {rest[0][2]}"
            out.append(" " * row[0][0] + joined + " " * max(row[1][0] - row[0][0] - len(joined), 3) + row[1][2])
            i += 3
        else:
            out.append(lines[i])
            i += 1
    return out


def test_wrapped_rows(spark):
    row = "    90% o menos de ventas locales, exentas o no                1%"
    docs = [[row, "", "          sujetas", "", "end"], [row, "", "sujetas", ""], [row, "", " " * 64 + "x", ""], [row, "", "          sujetas", "more"], [row, "", "          a    b", ""], [row, "          sujetas", ""], [], ["é   ü", "", " x"]]
    rng = random.Random(1)
    for _ in range(200):
        docs.append([rng.choice(["", "  ", " a b   c", "aaaaaa     b", "  x", "    yy", "a   b   c", "      long prose", row]) for _ in range(rng.randint(1, 8))])
    got, none = wrapped(spark, *docs)
    for d, g in zip(docs, got):
        assert g == plain_wrapped(d), d
    assert got[0][0].endswith("exentas o no sujetas        1%") and {k for k, d in enumerate(docs) if d and plain_wrapped(d) == d} == none


TABLE = """Prose above, unbroken and long enough to run over the columns.

Ingreso           Afiliado   Estado Art. 78
(colones) del afiliado, en colones
Hasta 100           3,5%      1,0%   10%
De 100 a 200        4,5%     11,0%    9%
Más de 200          5,5%      2,0%    8%

Prose below.""".split("\n")


def test_grids():
    out, problem = Y.grid_lines(TABLE, ["a", "b", "c", "d"])
    assert problem is None and out[:2] == TABLE[:2] and out[-2:] == ["", "Prose below."]
    assert "a: De 100 a 200 | b: 4,5% | c: 11,0% | d: 9%." in out and "Columnas de la tabla: a | b | c | d." in out and not any("colones" in x for x in out)
    assert Y.grid_lines(TABLE, ["a", "b", "c"])[1] == "no_grid" and Y.grid_lines([], ["a"] * 4)[1] == "no_grid" and Y.grid_lines(["prose"], [])[1] == "no_grid"
    twice = ["a    b    c", "d    e    f", "", "a    b    c", "d    e    f"]
    assert Y.grid_lines(twice, ["x", "y", "z"]) == (twice, "no_grid")
    tall = ["prose that is one unbroken line of words over all columns"] * 5 + ["a    b    c", "d    e    f"]
    assert Y.grid_lines(tall, ["x", "y", "z"]) == (tall, "long_header")
    assert Y.grid_lines(["a    b    c    d", "e    f         h", "i         k    l"], list("wxyz"))[0][3:5] == ["w: a | x: b | y: c | z: d.", ""]
    assert "x: —" in Y.grid_lines(["a    b    c    d", "e    f         h", "i         k    l"], list("wxyz"))[0][7]


def test_columns_against_plain():
    rng = random.Random(2)
    for _ in range(300):
        lines = ["".join(rng.choice("x é  ") for _ in range(rng.randint(0, 30))) for _ in range(rng.randint(1, 3))]
        inked = sorted({k for x in lines for k, c in enumerate(x) if c != " "})
        want = []
        for k in inked:
            if want and k - want[-1][1] < Y.GAP:
                want[-1] = want[-1][0], k + 1
            else:
                want.append((k, k + 1))
        ink = 0
        for x in lines:
            ink |= Y._ink(x)
        assert Y.columns_of(ink) == want, lines


def test_texts(spark):
    rows = spark.createDataFrame([(1, "\n".join(TABLE), list("abcd"), "x"), (2, None, list("abc"), "x"), (3, "no table", None, "x")], "doc_id long, text string, labels array<string>, problem string")
    got = {r.doc_id: r for r in Y.grid_texts(rows).collect()}
    assert got[1].problem is None and "d: 8%." in got[1].text and got[2].problem == got[3].problem == "no_grid" and got[3].text == "no table"
