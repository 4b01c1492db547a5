"""Which institution a question belongs to, which family of questions it is, and what is said or searched then.

Questions are read folded (without marks, lower case, blanks collapsed); a keyword counts once, where it
stands between signs that are no word characters. The tables are parameters; those below are the defaults.
A question without a text belongs nowhere. Rows are classified each on its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions import text as T
from lodestone.operators.answers import classify


def _table(lines: str) -> dict[str, list[str]]:
    return {name.strip(): [k.strip() for k in keywords.split(",")] for name, _, keywords in (x.partition(":") for x in lines.strip().splitlines())}


# Keywords by institution, in order; the first two are what is answered, the others are out of scope.
ROUTES = _table("""
hacienda: hacienda, tribu, tribu-cr, tributacion, iva, renta, impuesto, impuestos, factura, facturas, facturar, facturo, comprobante, comprobantes, cabys, declaracion, declarar, declaro, d-101, d-104, rut, atv, ovi, regimen simplificado, cnpt
ccss: ccss, caja, seguro social, sicere, ivm, sem, cuota, cuotas, asegurado, asegurada, asegurarme, aseguramiento, cotizar, cotizo, cotizacion, pension, ebais
ins: ins, instituto nacional de seguros, riesgos del trabajo, poliza, polizas, marchamo
municipal: patente, patentes, municipalidad, municipal, municipales, municipio, canton, uso de suelo, bienes inmuebles
registro-nacional: registro nacional, sociedad, sociedades, cedula juridica, personeria, sociedad anonima, srl, marca, marcas, escritura publica
colegios: colegio, colegios, colegiatura, colegiado, colegiada, colegiarme, incorporarme, cpic
bancos: banco, bancos, bancario, bancaria, prestamo, prestamos, hipoteca, hipotecario, sugef
meic: meic, pyme, pymes, mipyme, mipymes, registro pyme, consumidor
migracion: migracion, dimex, permiso de trabajo, nomada digital, nomadas digitales, residencia temporal, residencia permanente, estatus migratorio, categoria migratoria, visa, pasaporte
cosevi: cosevi, consejo de seguridad vial, licencia de conducir, licencias de conducir, licencia de manejo, licencias de manejo, licencia de manejar
mtss: mtss, ministerio de trabajo, codigo de trabajo, aguinaldo, cesantia, vacaciones, jornada, preaviso, liquidacion laboral, despido, horas extra
contadores: contador, contadora, contadores, cobrar por hora, cobro por hora, tarifa por hora, precio de mercado, precios de mercado, tarifas de mercado, honorarios profesionales
""")
IN_SCOPE, GENERAL = ("hacienda", "ccss"), "general"

# Keywords by family, in order.
FAMILIES = _table("""
T1-A: inscribir, inscribirme, inscribirse, inscribo, inscripcion, meterme en hacienda, registrarme, registro unico tributario, rut, atv
T1-B: asegurarme, asegurarse, asegurar, afiliarme, afiliarse, afiliar, afilio, afilia, afiliado, afiliada, afiliacion, obligado a asegurar, obligan a pagar, obligado a cotizar, gano poco, desde cuanta plata, desde cuanto
T1-C: factura electronica, comprobante, comprobantes, tiquete, recibo, cabys, codigo cabys, que codigo, cual codigo
T1-D: iva, valor agregado, d-104, en cero
T1-E: renta, utilidades, tramos, tramo, d-101, sin facturas, gastos, salario, asalariado, asalariada
T1-F: porcentaje, cuanto pago, cuanto se paga, lo minimo, cuota minima, escala, patrono, ingreso de referencia, base minima
T1-G: prescripcion, prescriban, prescribir, prescribe, prescritas, cuotas viejas, retroactivo, retroactivos, cobrar desde, cobrarme desde, ventana, 24 meses
T1-H: desinscribir, desinscribirme, desinscripcion, desinscrito, cese, cesar, deje de trabajar, dejar de trabajar, dejo de trabajar, salirme, me salgo, suspender, suspension, cierre de negocio, ya no trabajo
T1-I: multa, multas, sancion, sanciones, tarde, tardia, atrasado, atrasada, no haber declarado, no declare, sin declarar, rebajar la multa, rebaja de la multa, que me pasa
""")

# Words that name the subject of one document.
NAMED_SOURCES = {"cabys": "cabys-dev"}

# Institutions as a decline names them, and their addresses.
INSTITUTIONS = {
    "hacienda": ("Ministerio de Hacienda", "https://www.hacienda.go.cr"),
    "ccss": ("CCSS", "https://www.ccss.sa.cr"),
    "ins": ("Instituto Nacional de Seguros (INS)", "https://www.grupoins.com"),
    "municipal": ("la municipalidad de su cantón", "https://www.ifam.go.cr"),
    "registro-nacional": ("Registro Nacional", "https://www.rnpdigital.com"),
    "colegios": ("Colegio de Profesionales en Informática y Computación (CPIC)", "https://cpic.or.cr"),
    "bancos": ("su entidad bancaria", "https://www.sugef.fi.cr"),
    "meic": ("Ministerio de Economía, Industria y Comercio (MEIC)", "https://www.meic.go.cr"),
    "migracion": ("Dirección General de Migración y Extranjería", "https://www.migracion.go.cr"),
    "cosevi": ("Consejo de Seguridad Vial (COSEVI)", "https://www.csv.go.cr"),
    "mtss": ("Ministerio de Trabajo y Seguridad Social (MTSS)", "https://www.mtss.go.cr"),
    "contadores": ("el Colegio de Contadores Públicos de Costa Rica (CCPA)", "https://ccpa.or.cr"),
}

# Sentences of a decline.
OPENING = "No encuentro base oficial en los documentos que manejo para responder esta pregunta con confianza, y prefiero no adivinar."
SCOPE = "Hacienda y la CCSS para trabajadores independientes (personas físicas que trabajan por cuenta propia)"
FACTS = {
    "mtss": "El Código de Trabajo en general no aplica a quienes trabajan por cuenta propia: los derechos laborales del MTSS (aguinaldo, cesantía, vacaciones, jornada) son de las personas asalariadas.",
    "contadores": "Ni la tarifa de un servicio ni la escogencia de un profesional constan en una fuente oficial: son decisiones que se toman con una persona profesional en contabilidad o en asesoría de negocios, y no hay documento oficial que las fije.",
}
SOURCES, SOURCE = "Puede consultar directamente las fuentes oficiales:", "Puede consultar directamente la fuente oficial:"
OUTSIDE = "Queda fuera de lo que cubro: {scope}."
BELONGS = "Por el tema, la pregunta parece corresponder a {institution}, que está fuera de lo que cubro: {scope}."
COLLEGE = "Puede confirmar quién está colegiado directamente en el colegio:"


def route(question: Column, routes: dict[str, list[str]] = ROUTES) -> Column:
    """The institution: any that is out of scope with the most keywords (the first of equals), else the in-scope one with more, else ``general``."""
    folded = T.fold(question)
    outside = classify(folded, {k: v for k, v in routes.items() if k not in IN_SCOPE}, True)
    first, second = (T.keyword_hits(folded, routes[k]) for k in IN_SCOPE)
    inside = F.when(first > second, IN_SCOPE[0]).when(second > first, IN_SCOPE[1]).otherwise(GENERAL)
    return F.when(question.isNotNull(), F.coalesce(outside, inside))


def family(question: Column, families: dict[str, list[str]] = FAMILIES) -> Column:
    """The family with the most keywords, the last of equals; null without any."""
    return classify(T.fold(question), families, False)


def step_probes(questions: DataFrame, catalogue: DataFrame, families: dict[str, list[str]] = FAMILIES) -> DataFrame:
    """(query_id, family, place, sentence): the sentences (family, place, sentence) that are searched beside a question (query_id, text)."""
    asked = questions.select("query_id", family(F.col("text"), families).alias("family")).where("family IS NOT NULL")
    return asked.join(catalogue, "family").select("query_id", "family", "place", "sentence")


def named_sources(questions: DataFrame, names: dict[str, str] = NAMED_SOURCES) -> DataFrame:
    """(query_id, doc_key): documents that a question names by their subject, each once."""
    folded = T.fold(F.col("text"))
    found = F.array_compact(F.array(*(F.when(T.keyword_hits(folded, [word]) > 0, F.lit(key)) for word, key in names.items())))
    return questions.select("query_id", F.explode(F.array_distinct(found)).alias("doc_key"))


def decline(category: Column) -> Column:
    """What is said where nothing was found: both institutions for ``general``, the one in scope, or that the question is out of scope, a fact where there is one, and where to ask."""

    def said(name: str) -> str:
        links = "\n".join(f"- {i}: {url}" for i, url in (INSTITUTIONS[k] for k in (IN_SCOPE if name == GENERAL else (name,))))
        if name == GENERAL or name in IN_SCOPE:
            parts = [OPENING, SOURCES if name == GENERAL else SOURCE, links]
        elif name == "contadores":
            parts = [OPENING, FACTS[name], OUTSIDE.format(scope=SCOPE), COLLEGE, links]
        else:
            parts = [OPENING, BELONGS.format(institution=INSTITUTIONS[name][0], scope=SCOPE), *([FACTS[name]] if name in FACTS else []), SOURCE, links]
        return "\n\n".join(parts)

    texts = F.create_map(*(F.lit(x) for name in (*INSTITUTIONS, GENERAL) for x in (name, said(name))))
    return F.element_at(texts, category)
