"""Word lists, formats and weights whose exact content defines the results."""

# Words of 0 to 29, of the tens and of the hundreds, by position.
ONES = [
    "cero", "uno", "dos", "tres", "cuatro", "cinco", "seis", "siete", "ocho", "nueve", "diez", "once", "doce", "trece", "catorce",
    "quince", "dieciseis", "diecisiete", "dieciocho", "diecinueve", "veinte", "veintiuno", "veintidos", "veintitres", "veinticuatro",
    "veinticinco", "veintiseis", "veintisiete", "veintiocho", "veintinueve",
]
TENS = ["", "", "", "treinta", "cuarenta", "cincuenta", "sesenta", "setenta", "ochenta", "noventa"]
HUNDREDS = ["", "ciento", "doscientos", "trescientos", "cuatrocientos", "quinientos", "seiscientos", "setecientos", "ochocientos", "novecientos"]
# Letters that stand for digits inside a number.
LOOKALIKES = {"o": "0", "O": "0", "l": "1", "I": "1", "|": "1", "s": "5", "S": "5", "B": "8", "Z": "2"}
# Letters that stand for digits inside a magnetic line, and inside dates by two dialects.
LINE_LOOKALIKES = {"O": "0", "o": "0", "D": "0", "Q": "0", "C": "4", "S": "5", "s": "5", "B": "8", "I": "1", "l": "1", "|": "1", "Z": "2", "G": "6", "b": "6"}
DATE_LOOKALIKES = {"o": "0", "O": "0", "D": "0", "l": "1", "I": "1", "|": "1", "i": "1", "Z": "2", "z": "2", "a": "2", "s": "5", "S": "5", "b": "6", "G": "6", "g": "9", "q": "9", "B": "8", "T": "7"}
DATE_LOOKALIKES_REPAIR = {"o": "0", "O": "0", "d": "0", "D": "0", "i": "1", "I": "1", "l": "1", "L": "1", "|": "1", "s": "5", "S": "5", "z": "2", "Z": "2", "b": "6", "g": "9", "q": "9", "a": "9"}
# English months.
MONTHS_ENGLISH = {
    "january": 1, "february": 2, "march": 3, "april": 4, "may": 5, "june": 6, "july": 7, "august": 8, "september": 9, "october": 10, "november": 11, "december": 12,
    "jan": 1, "apr": 4, "aug": 8, "dec": 12,
}
# Written dates that may stand anywhere in a text. D day, N month in digits, Y year, M month word, S separator.
DATES_ANYWHERE = [
    r"\bD(?:\s*\bde\s+|S)M(?:\s*\bdel?\s+|S)Y\b",
    r"\bYSMSD\b",
    r"\bMSDSY\b",
    r"\bY\s*[/\-.,]\s*N\s*[/\-.,]\s*D\b",
    r"\bD\s*[/\-.]\s*N\s*[/\-.]\s*Y\b",
]
# Forms of amounts in figures of the bilingual and of the repair dialect.
AMOUNT_BILINGUAL = r"(?<![0-9/])([0-9]{1,3}(?:[.,' ][0-9]{3})+(?:[.,][0-9]{1,2})?|[0-9]+(?:[.,][0-9]{1,2})?)(?![0-9/])"
AMOUNT_REPAIR = r"[0-9]{1,3}(?:[.,\s][0-9]{3})+(?:[.,][0-9]{1,2})?|[0-9]+[.,][0-9]{1,2}|[0-9]+"
CURRENCY_SIGNS = r"(?i)us\s*\$|usd|\$|s/\.?|€|\*|#"

# Answers that mean "absent".
NEGATIVES = ["no", "n", "false", "falso", "0", "ausente", "sin firma", "no presente", "no detectada", "no detectado", "ninguna", "ninguno", "null", "none"]
# Answers that mean "present" without saying more.
YES_WORDS = ["si", "yes", "true", "verdadero", "presente"]

# Months by name, abbreviation and roman numeral.
MONTHS = {"enero": 1, "febrero": 2, "marzo": 3, "abril": 4, "mayo": 5, "junio": 6, "julio": 7, "agosto": 8, "septiembre": 9, "setiembre": 9, "octubre": 10, "noviembre": 11, "diciembre": 12}
MONTHS_SHORT = {"ene": 1, "feb": 2, "mar": 3, "abr": 4, "may": 5, "jun": 6, "jul": 7, "ago": 8, "sep": 9, "sept": 9, "set": 9, "oct": 10, "nov": 11, "dic": 12}
MONTHS_ROMAN = {"i": 1, "ii": 2, "iii": 3, "iv": 4, "v": 5, "vi": 6, "vii": 7, "viii": 8, "ix": 9, "x": 10, "xi": 11, "xii": 12}

# Number words of the strict parser, two common misspellings included.
UNITS = {
    "cero": 0, "un": 1, "uno": 1, "una": 1, "dos": 2, "tres": 3, "cuatro": 4, "cinco": 5, "seis": 6, "siete": 7, "ocho": 8, "nueve": 9,
    "diez": 10, "once": 11, "doce": 12, "trece": 13, "catorce": 14, "quince": 15, "dieciseis": 16, "diecisiete": 17, "dieciocho": 18, "diecinueve": 19,
    "veinte": 20, "veintiun": 21, "veintiuno": 21, "veintidos": 22, "veintitres": 23, "veinticuatro": 24, "veinticinco": 25, "veintiseis": 26, "veintisiete": 27, "veintiocho": 28, "veintinueve": 29,
    "treinta": 30, "cuarenta": 40, "cincuenta": 50, "sesenta": 60, "setenta": 70, "ochenta": 80, "noventa": 90,
    "cien": 100, "ciento": 100, "doscientos": 200, "docientos": 200, "trescientos": 300, "tresientos": 300, "cuatrocientos": 400, "quinientos": 500, "seiscientos": 600, "setecientos": 700, "ochocientos": 800, "novecientos": 900,
}
# Words that a written amount may hold without meaning a number.
FILLERS = ["y", "dolares", "dolar", "usd", "ctvs", "centavos", "centavo", "son", "la", "suma", "de"]

# Accepted spellings of each field's key, most wanted first.
ALIASES = {
    "cuenta_no": ["cuenta_no", "numero_cuenta", "numero_de_cuenta", "nro_cuenta", "num_cuenta", "no_cuenta", "cuenta", "cta", "cuenta_corriente"],
    "cheque_no": ["cheque_no", "numero_cheque", "numero_de_cheque", "nro_cheque", "num_cheque", "no_cheque", "cheque"],
    "a_la_orden_de": ["a_la_orden_de", "a_la_orden", "pagese_a", "paguese_a", "pague_a", "beneficiario", "orden_de", "nombre_beneficiario"],
    "valor_numero": ["valor_numero", "valor_numerico", "valor", "monto", "importe", "cantidad", "valor_en_numeros"],
    "valor_texto": ["valor_texto", "valor_letras", "valor_en_letras", "monto_letras", "importe_letras", "cantidad_letras"],
    "cliente": ["cliente", "nombre_cliente", "girador", "librador", "titular", "cuenta_habiente", "ordenante"],
    "fecha": ["fecha", "fecha_emision", "fecha_cheque", "fecha_del_cheque"],
    "lugar": ["lugar", "ciudad", "plaza", "lugar_emision"],
    "endoso": ["endoso", "endosos", "endoso_texto", "texto_endoso", "detalle_endoso"],
    "endoso_flag": ["endoso_presente", "tiene_endoso", "endosado", "endoso"],
    "firma": ["firma_presente", "tiene_firma", "firma", "firmas"],
}

# Named date formats. Y year, N day or month in digits, D day, W and L month words of at least three
# and four letters, A abbreviated month, P month word with an optional full stop, R roman month.
DATE_FORMATS = {
    "aaaa/mm/dd": "Y/N/D",
    "aaaa-mm-dd": "Y-N-D",
    "aaaa, mm, dd": "Y,N,D",
    "aaaa, mes, dd": "Y,W,D",
    "aaaa, mes abreviado, dd": "Y,A,D",
    "aaaa, mes romano, dd": "Y,R,D",
    "dd de mes de aaaa": "D_de_L_de_Y",
    "dd de mes del aaaa": "D_de_L_del_Y",
    "dd de mes abreviado. de aaaa": "D_de_A_de_Y",
    "dd de mes abreviado. del aaaa": "D_de_A_del_Y",
    "dd de mes romano de aaaa": "D_de_R_de_Y",
    "dd de mes abreviado. aaaa": "D_de_A_Y",
    "mes dd, aaaa": "W_D,Y",
    "dd de mes/ aaaa": "D_de_P/Y",
    "mes abreviado. dd/aaaa": "A_D/Y",
    "aaaa mes dd": "Y_P_D",
    "dd mes aaaa": "D_P_Y",
}
# The rules a report may check.
RULES = ["firma", "beneficiario", "coincide_valor", "fecha_correcta", "endoso"]

# Further number words of the tolerant parser, and words it skips.
TOLERANT_UNITS = {
    "veintiuna": 21, "veinti": 20, "venti": 20, "doscientas": 200, "trescientas": 300, "cuatrocientas": 400, "quinientas": 500,
    "seiscientas": 600, "setecientas": 700, "ochocientas": 800, "novecientas": 900,
}
TOLERANT_FILLERS = ["y", "de", "dolares", "dolar", "usd", "us", "moneda", "americanos", "norteamericanos", "exactos", "son", "la", "suma", "los", "estados", "unidos", "america", "00", "pesos", "m"]
TOLERANT_EXTRA = ["con", "centavo", "centavos", "ctvs", "cts", "del", "solo", "cientos", "cientas"]
# The tolerant parser's vocabulary besides these: the strict number words without two misspellings, and scales.
TOLERANT_WORDS = [w for w in UNITS if w not in ("docientos", "tresientos")]
SCALES = ["mil", "millon", "millones"]
# Pairs of letters that scanners read for one, in the order in which they are undone.
DIGRAPHS = [("+", "t"), ("rn", "m"), ("vv", "w"), ("ii", "u"), ("cl", "d")]
# Digits that scanners put into words.
DIGIT_LETTERS = {"1": "i", "0": "o", "5": "s", "3": "e", "4": "a", "8": "b"}

# Weights and thresholds of the deciders.
REVIEW_BELOW = 0.80
PRINTED_WEIGHT = 0.4
NUMBER_MARGIN = 4.0
REQUIRED_FLOOR = 0.6
AMOUNT_FIT = -0.5
AMOUNT_MARGIN = 5.0
DATE_MARGIN = 3.0
# What stands for a letter of a printed label, once accents and case are gone; fillers behind a label; name particles that stay small.
SEEN_AS = {"a": "[a@]", "e": "e", "i": "[i1l!|]", "o": "[o0]", "u": "[uv]", "n": "n", "s": "[s5$]", " ": r"\s*", ".": r"\.?"}
AFTER_LABEL = r"[\s:.\-_=*]*"
PARTICLES = ["de", "del", "la", "las", "los", "y"]

# Runs of signs that fill a line, and signs that hang at a value's ends.
FILLER_RUNS = r"(?i)[-_=*~]{2,}|(?<![a-z])x{3,}(?![a-z])"
FILLER_ENDS = r"^[\s\-_=*~.:,;#]+|[\s\-_=*~.:,;#]+$"
# A payee's printed label before the name, as misread, and the amount behind it; words that its rests leave.
PAYEE_LABEL = r"(?i)^.*?(orden\s*de|ordende|ala\s*orden)\s*"
PAYEE_AMOUNT = r"(?i)\bus\W*\$.*$"
LABEL_RESTS = ["a", "la", "al", "de"]
LABEL_WORDS = ["orden", "paguese", "ordende"]
# Printed labels before a deep reader's payee and city.
DEEP_PAYEE = r"(?iu)^\W*(p[aá]guese\s*a\s*)?(la\s*)?orden\s*de\W*"
DEEP_AMOUNT = r"(?i)\s*u\.?\s*s\.?\s*\$.*$"
CITY_LABEL = r"(?iu)^\W*(ciudad\s*(y\s*fecha)?|lugar\s*y\s*fecha(\s*de\s*emisi[oó]n)?)\W*"
# Cents as scanners read them, and the groups of digits that they spoil.
CENTS_READ = r"(?<![0-9])([0-9]{2})\s*(?:[/|)(\]\[{}!1lI]\s*){1,3}[0oOcCQ]{2}(?![a-z])|(?<![0-9])([0-9]{2})\s+[cC][oO0](?![a-z])"
SPOILED_DIGITS = r"(?<![a-zA-Z])[0-9oO][0-9oOcClI/|)(\]\[]*(?![a-zA-Z])"
# Pieces of print that no field holds; the look of a date; where a blank was lost before a digit; words that tell a written amount.
PRINT = ["banco", "compania", "anonima", "invadir", "rasgos", "caligraf", "sellos", "superintendencia", "formulario", "agencia", "didactico", "comercial", "ctacte", "valor", "seguros"]
DATE_FORM = r"[0-9]{1,4}\s*[-/.]\s*[0-9]{1,2}\s*[-/.]\s*[0-9]{1,4}"
LETTER_THEN_DIGIT = r"(?<=[A-Za-z.])(?=[0-9])"
NUMBER_SPEECH = [*TOLERANT_WORDS, *TOLERANT_UNITS, *SCALES, "centavos", "centavo", "dolares", "dolar", "cientos"]

# Number words of the bilingual parser (Spanish ones as above, without the misspellings), and the words round them.
BILINGUAL_UNITS = {k: v for k, v in UNITS.items() if k in TOLERANT_WORDS} | {k: v for k, v in TOLERANT_UNITS.items() if k not in ("veinti", "venti")} | {
    "zero": 0, "one": 1, "two": 2, "three": 3, "four": 4, "five": 5, "six": 6, "seven": 7, "eight": 8, "nine": 9, "ten": 10, "eleven": 11, "twelve": 12, "thirteen": 13,
    "fourteen": 14, "fifteen": 15, "sixteen": 16, "seventeen": 17, "eighteen": 18, "nineteen": 19, "twenty": 20, "thirty": 30, "forty": 40, "fifty": 50, "sixty": 60, "seventy": 70, "eighty": 80, "ninety": 90,
}
BILINGUAL_SCALES = {"mil": 1000, "thousand": 1000, "millon": 1_000_000, "millones": 1_000_000, "million": 1_000_000}
BILINGUAL_CONNECTORS = ["y", "and", "de", "del", "la", "suma", "cantidad", "the", "sum", "of", "only", "solo", "son"]
BILINGUAL_CURRENCIES = ["dolares", "dolar", "dollars", "dollar", "pesos", "peso", "soles", "euros", "usd", "us", "bolivares", "quetzales", "colones", "lempiras", "cordobas", "guaranies", "reales"]
BILINGUAL_CENTS = ["centavos", "centavo", "cents", "cent", "ctvs", "ctv", "cvs"]
BEFORE_CENTS = ["con", "and", "with"]
CENTS_FRACTION = r"(?<![a-z])([0-9o]{1,2})\s*/\s*[1l][0o]{2}"
# Spellings with accents, of folded words; cents of the repair dialect, and the letters read for their digits.
CANONICAL = {"dieciseis": "dieciséis", "veintidos": "veintidós", "veintitres": "veintitrés", "veintiseis": "veintiséis", "millon": "millón", "dolares": "dólares", "dolar": "dólar"}
CENTS_REPAIR = r"([0-9odilszbgq]{1,2})\s*/\s*[1il][0o]{2}"
CENTS_LOOKALIKES = {"o": "0", "d": "0", "i": "1", "l": "1", "s": "5", "z": "2", "b": "6", "g": "9", "q": "9"}
# Whole lines of print, compact, and how alike to one a text must be that is print as well.
LEGENDS = ["companiaanonima", "bancoestudiantilvenus", "noinvadirestazonaconrasgoscaligraficosnisellos", "lugaryfechadeemision", "paguesealaordende", "usdolares"]
LEGEND_LEAST = 0.7
# Lines of a transcript that are printed labels.
LABEL_LINE = r"(?i)\W*(la\s*)?suma\s*de\W*|\W*uma de\W*|.*fecha de emisi.*|\W*d[oó]lares\W*"
# Least likeness of a printed character to its template, and least lead over the next class.
TEMPLATE_LEAST, TEMPLATE_MARGIN = 0.55, 0.06

# Printed labels of fields, by field, most particular first; the band of a page above its magnetic line; tokens that are a currency sign.
PAYEE_LABELS = ["paguese a la orden de", "pagase a la orden de", "paguese a la orden", "paguese por este cheque a", "pay to the order of", "a la orden de", "paguese a", "pay to the", "pay to", "orden de", "paguese", "beneficiario"]
WORDS_LABELS = ["la cantidad de", "la suma de", "the sum of", "cantidad de", "suma de", "son:"]
ACCOUNT_LABELS = ["cuenta corriente no", "cuenta corriente", "cta. cte. no", "cta. cte.", "cta cte", "cuenta no", "cuenta", "cta.", "account no", "account", "acct"]
CONCEPT_LABELS = ["por concepto de", "concepto", "memo", "referencia", "detalle"]
DATE_LABELS = ["lugar y fecha", "fecha", "date"]
FIELD_LABELS = [*PAYEE_LABELS, *WORDS_LABELS, *CONCEPT_LABELS, "firma", "autorizada"]
BAND_TOP = 0.78
CURRENCY_TOKEN = r"(?i)^\s*(us\s*\$|usd|\$|s/\.?|€|mx\$|col\$)\s*$"
ACCOUNT_FORM = r"[0-9][0-9\- ]{4,20}[0-9]"
AMOUNT_AFTER_NAME = r"(?i)\s*(us\s*\$|usd|\$)\s*[0-9.,*\s]*$"
