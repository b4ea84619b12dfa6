"""Who a clause speaks of, and in which case: mentions, payers, right holders, released parties."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from clausewise.dims import STEMS, TYPES, lookup
from clausewise.functions.text import after, before, has, spans

MENTION = "array<struct<start:int,end:int,role:string,gcase:string>>"
LETTERS = "а-яёәғқңөұүһіa-z"

# Third parties, mutual wording, verbs of paying and of rights.
THIRD_PARTY = r"(?:генеральн|конечн|основн|своего|его|третьих|иного|другого)\w*\s+$"
MUTUAL = {
    "ru": (
        r"(?:\bстороны\b(?!\s+(?:арендатор|арендодател|поставщик|покупател|подрядчик|заказчик|исполнител)\w*)|кажд\w+\s+из\s+сторон|любая\s+(?:из\s+)?сторон|ни\s+одна\s+из\s+сторон"
        r"|виновная\s+сторона|сторона,\s+(?:не\s+исполнившая|нарушившая|ненадлежащим)|сторона,\s+для\s+которой|сторона\s+освобождается|сторона,\s+допустившая)"
    ),
    "kk": r"(?:\bтараптар\b|тараптардың\s+әрқайсысы|кез\s+келген\s+тарап|әрбір\s+тарап|тараптардың\s+ешқайсысы|кінәлі\s+тарап|ешбір\s+тарап)",
}
PAYS = {
    "ru": r"(?:уплачива\w*|выплачива\w*|оплачива\w*|платит|обязан\w*\s+(?:уплатить|выплатить|оплатить)|несет|возмеща\w*|компенсир\w*|обязан\w*\s+компенсировать|обязан\w*\s+возместить)",
    "kk": r"(?:төлейді|төлеуге\s+міндетті|өтейді|өтеуге\s+міндетті|жауапты\s+болады|жауап\s+береді)",
}
RIGHT = {"ru": r"(?<!не\s)(?:вправе|имеет\s+право|может|могут|по\s+своему\s+усмотрению)", "kk": r"(?:құқылы|құқығы\s+бар|\w+\s+алады)"}

def column(name: str):
    """A column by name, made when it is asked for: columns need a session, modules load without one."""
    return lambda: F.col(name)


TEXT, TYPE, LANG, MENTIONS = column("text"), column("contract_type"), column("lang"), column("mentions")


def role_forms(contract_type: str, language: str) -> tuple[str, dict[str, str]]:
    """One pattern for all role nouns of a type's two parties, and what each of their forms says: role and case."""
    alternatives, forms = [], {}
    for role in TYPES[contract_type]:
        for stem, endings in STEMS[language].get(role, ()):
            ends = "|".join(sorted(filter(None, endings), key=len, reverse=True))
            alternatives.append(f"{stem}(?:{ends})?")
            forms |= {stem.replace(r"\s+", " ") + end: f"{role} {case}" for end, case in endings.items()}
    return rf"(?<![{LETTERS}])(?:{'|'.join(alternatives)})(?![{LETTERS}])", forms


def mentions() -> Column:
    """Role nouns of the contract's two parties in order of place; third parties of the same name are left out."""
    text, contract_type, lang = TEXT(), TYPE(), LANG()
    empty = F.array().cast(MENTION)

    def named(forms: dict[str, str]):
        def of(s: Column) -> Column:
            said = lookup(forms, F.lower(F.regexp_replace(s["hit"], r"(?U)\s+", " ")))
            return F.struct(s["start"].alias("start"), s["end"].alias("end"), F.substring_index(said, " ", 1).alias("role"), F.substring_index(said, " ", -1).alias("gcase"))

        return of

    found = None
    for t in TYPES:
        for language in STEMS:
            pattern, forms = role_forms(t, language)
            here = (contract_type == t) & (lang == language)
            value = F.transform(spans(text, pattern), named(forms))
            found = F.when(here, value) if found is None else found.when(here, value)
    known = F.filter(found.otherwise(empty), lambda m: m["gcase"].isNotNull() & ~has(before(text, m["start"], 30), THIRD_PARTY))
    return F.coalesce(F.array_sort(known), empty)


def mutual() -> Column:
    text, lang = TEXT(), LANG()
    return F.when(lang == "kk", has(text, MUTUAL["kk"])).otherwise(has(text, MUTUAL["ru"]))


def followed(m: Column, pattern: str, n: int = 80) -> Column:
    return has(after(TEXT(), m["end"], n), rf"^[^.;]*?{pattern}")


def preceded(m: Column, pattern: str, n: int = 40) -> Column:
    return has(before(TEXT(), m["start"], n), rf"{pattern}\s*$")


def in_case(*cases: str) -> Column:
    return F.array_distinct(F.transform(F.filter(MENTIONS(), lambda m: m["gcase"].isin(*cases)) if cases else MENTIONS(), lambda m: m["role"]))


def chosen(test) -> Column:
    return F.array_distinct(F.transform(F.filter(MENTIONS(), test), lambda m: m["role"]))


def payers() -> Column:
    kk = chosen(lambda m: (m["gcase"] == "abl") | ((m["gcase"] == "nom") & followed(m, PAYS["kk"], 250)))
    ru = chosen(
        lambda m: ((m["gcase"] == "gen") & preceded(m, r"(?:\bс|\bсо|\bдля)"))
        | (m["gcase"].isin("gen", "nom") & preceded(m, r"не\s+освобождает(?:\s+\w+){0,2}"))
        | ((m["gcase"] == "ins") & preceded(m, r"(?:уплачиваем\w*|выплачиваем\w*|оплачивается|уплачивается|выплачивается)"))
        | ((m["gcase"] == "nom") & followed(m, PAYS["ru"]))
    )
    found = F.when(LANG() == "kk", kk).otherwise(ru)
    alone = in_case("nom")
    holds = F.exists(MENTIONS(), lambda m: (m["gcase"] == "nom") & F.when(LANG() == "kk", followed(m, RIGHT["kk"], 60)).otherwise(followed(m, RIGHT["ru"], 60)))
    return F.when(F.size(found) > 0, found).when((F.size(alone) == 1) & ~holds, alone).otherwise(F.array().cast("array<string>"))


def burden(payers_: Column, mutual_: Column) -> Column:
    """(against, mutual) of a clause about money; null if it can't be told."""
    all_ = in_case()
    one = lambda a, b: F.struct(a.alias("against"), F.lit(b).alias("mutual"))
    return F.when(F.size(payers_) > 0, one(payers_, False)).when(mutual_, one(both(), True)).when(F.size(all_) == 1, one(all_, False))


def both() -> Column:
    out = None
    for t, rs in TYPES.items():
        pair = F.array(*map(F.lit, rs))
        out = F.when(TYPE() == t, pair) if out is None else out.when(TYPE() == t, pair)
    return out


def side(i: int) -> Column:
    """0: the drafting party, 1: the other one."""
    return lookup({t: rs[i] for t, rs in TYPES.items()}, TYPE())


def right_holders(ru: str, kk: str) -> Column:
    return F.when(LANG() == "kk", chosen(lambda m: (m["gcase"] == "nom") & followed(m, kk, 250))).otherwise(
        chosen(lambda m: ((m["gcase"] == "nom") & followed(m, rf"{RIGHT['ru']}[^.;]{{0,80}}?{ru}", 200)) | ((m["gcase"] == "ins") & preceded(m, rf"{ru}\w*(?:\s+\w+){{0,3}}", 80)))
    )


def released(pattern: str) -> Column:
    """Subjects of a verb: nominatives that are the nearest to the verb found around them."""
    nominative = F.filter(MENTIONS(), lambda m: m["gcase"] == "nom")

    def verb(m: Column) -> Column:
        window = F.concat(before(TEXT(), m["start"], 120), F.substring(TEXT(), m["start"] + 1, m["end"] - m["start"] + 150))
        return F.greatest(m["start"] - 120, F.lit(0)) + F.get(spans(window, pattern), F.lit(0))["start"]

    def nearest(m: Column) -> Column:
        return F.coalesce(F.array_min(F.transform(nominative, lambda x: F.struct(F.abs(x["start"] - verb(m)), x["start"])))["start"] == m["start"], F.lit(False))

    return F.array_distinct(F.transform(F.filter(nominative, nearest), lambda m: m["role"]))
