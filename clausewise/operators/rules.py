"""Rules over clauses: each says who a clause burdens, how much, and by which words.

A clause (text, contract_type, lang) gets its mentions, percentages and durations once; every rule is
a column over them that yields an array of hits, so one projection runs them all without a join. Whose
risk a hit is (`against`) is matched with the reader's role afterwards.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clausewise.dims import TYPE_OF, counterparty, lookup
from clausewise.functions import numbers
from clausewise.functions.text import after, before, has, spans
from clausewise.operators import parties
from clausewise.operators.parties import LANG, MENTIONS, TEXT, TYPE, column, right_holders

LOW, MEDIUM, HIGH = 1, 2, 3
HIT = "array<struct<rule_id:string,category:string,level:int,against:array<string>,evidence:array<struct<start:int,end:int>>,details:map<string,string>>>"

# Wordings the rules look for.
LOST_PROFIT = r"(?:упущенн\w+\s+выгод|неполученн\w+\s+доход|косвенн\w+\s+(?:убытк|ущерб)|жіберілген\s+пайда|жанама\s+залал)"
LOST_PROFIT_EXCLUDED = r"(?:упущенн\w+\s+выгод\w*\s+(?:возмещению\s+)?не\s+(?:подлежит|возмещается)|не\s+возмеща\w+\s+упущенн|жіберілген\s+пайда\s+өтелмейді)"
OVER_PENALTY = r"(?:сверх\s+неустойк|помимо\s+неустойк|независимо\s+от\s+(?:уплаты\s+)?неустойк|тұрақсыздық\s+айыбынан\s+бөлек|не\s+засчитыва\w+\s+в\s+(?:сумму\s+)?убытк)"
NOT_LIABLE_RU = r"(?:не\s+нес[её]т\s+(?:никакой\s+)?ответственност\w*|не\s+отвечает|освобождается\s+от\s+(?:любой\s+)?ответственност)"
NOT_LIABLE_KK = r"(?:жауапты\s+болмайды|жауапкершілік\s+атқармайды|жауап\s+бермейді|жауапкершіліктен\s+босатылады)"
BROAD = r"(?:какие[-\s]либо|каки[хм]-либо|любы[еохм]\w*|любой|ни\s+при\s+каких|за\s+вс[её]\b|за\s+все\b|в\s+том\s+числе\s+(?:в\s+случае|при)|кез\s+келген|ешбір\s+жағдайда|барлық)"
FORCE_MAJEURE = r"(?:непреодолим\w*\s+сил|форс-?\s?мажор|еңсерілмейтін\s+күш|форс-мажорлық)"
RELEASED = r"(?:освобожда\w+|босатылады)"
TERMINATION_CONTEXT = r"(?:досрочн\w+\s+(?:расторжени|прекращени)|прекраща\w+\s+аренду\s+досрочно|до\s+истечения\s+срока|мерзімінен\s+бұрын|обеспечительн|гарантийн\w+\s+взнос|депозит|кепілдік)"
RENEWAL = (
    r"(?:считается\s+(?:продлен|пролонгирован|возобновлен)\w*|считать\s+продлен\w*|продлева\w+\s+автоматически|автоматически\s+(?:продлева|пролонгир|продлит)\w*"
    r"|пролонгиру\w+\s+автоматически|ежегодно\s+пролонгир\w+|(?<!быть\s)пролонгируется|продлевается\s+на\s+(?:тот\s+же|следующ|кажд|новый)|ұзартылды\s+деп\s+есептеледі|автоматты\s+түрде\s+ұзартылады)"
)
BY_AGREEMENT = r"(?:по\s+(?:письменному\s+)?(?:заявлению|соглашению)|дополнительн\w+\s+соглашени|может\s+быть\s+продл)"
DISCRETION = r"(?:самостоятельно|по\s+своему\s+усмотрению|которые\s+определит|устанавлива\w+\s+\w+ем\b|установить\s+новые|вправе\s+установить|өз\s+бетінше)"
PRICE = r"(?:цен\w*|ставк\w*|арендн\w+\s+плат\w*|стоимост\w*|жалдау\s+ақы\w*)"
MUST_NOTIFY = r"не\s+(?:уведом|направ|заяв|сообщ)\w*"
DISPUTE = r"(?:спор|суд|арбитраж|разногласи|дау|сот|төрелік)"
FOREIGN = (
    r"(?:лондон\w*|\bLCIA\b|\bICC\b|стокгольм\w*|сингапур\w*|швейцар\w*|при\s+(?:ТПП|торгово-промышленной\s+палате)\s+российской"
    r"|прав\w*\s+(?:англии|российской\s+федерации|швеции|сингапура)|английск\w+\s+прав\w*|англия\s+құқығы)"
)
AIFC = r"(?:МФЦА|\bAIFC\b|международн\w+\s+финансов\w+\s+центр\w*\s+«?астана»?|АХҚО)"
TERMINATE_RU = r"(?:расторг\w*|отказ\w*\s+от\s+(?:исполнения\s+)?(?:настоящего\s+)?договор\w*)"
TERMINATE_KK = r"(?:бұзуға|бұза\s+алады|бас\s+тартуға|бас\s+тарта\s+алады)"
NO_NOTICE = (
    r"(?:без\s+(?:\w+\s+){0,2}(?:уведомления|предупреждения)|в\s+любое\s+время|в\s+любой\s+момент|без\s+(?:объяснения|указания)\s+причин|в\s+день\s+(?:расторжения|отказа)|немедленно"
    r"|ескертпей|себебін\s+түсіндірмей|кез\s+келген\s+уақытта)"
)
BREACH = r"(?:\bесли\b|в\s+случае|\bпри\b|\bегер\b)[^.;]{0,80}?(?:нарушени|неуплат|невнесени|просрочк|неисполнени|не\s+внес|не\s+оплат|более\s+двух\s+раз|бұзған|төлемеген)"
VAGUE_BREACH = r"(?:при\s+любом\s+нарушени|в\s+случае\s+любого\s+нарушени)"
PAYS_FOR_WORK = r"(?:уплатив|оплатив|возместив|с\s+оплатой\s+(?:фактически\s+)?выполненн)"
CANNOT_EXIT = r"(?:не\s+вправе|не\s+имеет\s+права|не\s+может)\s+(?:\w+\s+){0,2}?(?:досрочно\s+)?(?:расторг|отказ\w*\s+от)"
EXIT_BARRED = r"досрочн\w+\s+(?:расторжени|прекращени)\w*[^.;]{0,40}по\s+инициативе\s+[^.;]{0,30}не\s+допуска"
EARLY = r"(?:досрочн\w+\s+(?:расторжени|прекращени|отказ)|прекраща\w+\s+аренду\s+досрочно|до\s+истечения\s+срока|раньше\s+(?:окончания|истечения)\s+срок|ранее\s+срока|мерзімінен\s+бұрын\s+бұз)"
FEE = r"(?:уплачивает|выплачивает|компенсаци\w*|штраф\w*|төлейді|өтемақы)"
REMAINDER = r"(?:весь\s+оставш\w+|оставш\w+\s+(?:срок|период)|до\s+конца\s+срока|қалған\s+бүкіл\s+мерзім)"
NO_FEE = r"(?:без\s+(?:уплаты\s+)?компенсаци|без\s+применения|без\s+возмещения)"
DEPOSIT = r"(?:обеспечительн\w+\s+платеж|гарантийн\w+\s+взнос|депозит|кепілдік\s+жарна)"
FORFEIT = r"(?:не\s+возвраща\w+|возврату\s+не\s+подлежит|не\s+подлежит\s+возврату|оста[её]тся\s+у|удерживается|невозвратн\w+|засчитывается\s+в\s+пользу|қайтарылмайды)"
ANY_END = r"(?:ни\s+при\s+каких|при\s+любом\s+(?:прекращении|расторжении)|в\s+том\s+числе\s+при\s+расторжении|невозвратн|кез\s+келген\s+жағдайда)"
CHANGE_RU = r"(?:измен|увелич|пересматрива|пересмотр|индексир|повыша|повыс)"
CHANGE_KK = r"(?:өзгертуге|арттыра\s+алады|көтеруге|арттыруға)"
CHANGE_OBJECT = r"(?:цен\w*|стоимост\w*|арендн\w+\s+плат\w*|ставк\w*|тариф\w*|прайс|жалдау\s+ақы\w*)"
CHANGE_TERMS = r"(?:услови\w+\s+(?:настоящего\s+)?договора|настоящий\s+договор)"
CHANGE_CAPPED = r"(?:не\s+более\s+чем\s+на\s+\d|в\s+пределах\s+(?:официального\s+)?уровня\s+инфляции|не\s+более\s+\d+\s*%|\d+\s*%\s+в\s+год)"
ONE_SIDED = r"(?:в\s+одностороннем\s+порядке|без\s+согласовани\w*(?:\s+с\s+\w+)?|без\s+согласия|самостоятельно|оспариванию\s+не\s+подлежит|біржақты\s+тәртіппен|келісімінсіз)"
PREPAID = (
    r"(?:100\s*%\s*(?:\([^)]*\)\s*)?(?:предоплат|предварительн\w+\s+оплат|аванс)|полн\w+\s+предоплат|полн\w+\s+предварительн\w+\s+оплат|стопроцентн\w+"
    r"|полн\w+\s+(?:стоимост\w+|сумм\w+)\s+(?:\w+\s+){0,2}авансом|100\s*%\s+[^.;]{0,40}до\s+(?:отгрузки|поставки|начала))"
)
PAYMENT = r"(?:оплачива|оплат|расч[её]т|рассчитыва|перечисля)"
NOT_PAYMENT = r"(?:гарантийн\w+\s+срок|претензи|приемк|считаются\s+принят)"
PAY_WHEN_PAID = (
    r"(?:(?:после|с\s+момента)\s+(?:получения|поступления)\s+(?:\w+\s+){0,2}(?:оплаты|денежных\s+средств|средств)|поступ\w+\s+(?:на\s+его\s+сч[её]т\s+)?(?:оплат\w+|денежн\w+\s+средств\w*|средств\w*))"
    r"\s+от\s+(?:генеральн|конечн|основн|его|своего|третьих|арендатор|заказчик\w*\s+по|покупател\w*\s+по)"
)
SILENT = r"(?:считаются|считается|считать)\s+принят\w*"
CLAIMS = r"(?:претензи\w*|недостатк\w*|дефект\w*|рекламаци\w*)"
HIDDEN_WARRANTY = r"скрыт\w+[^.;]{0,60}(?:гарантийн\w+\s+срок|в\s+пределах\s+гарантийн)"
REFUSAL = r"(?:отказаться\s+от\s+приемки|не\s+принимать|не\s+подписывать\s+акт|отказыва\w+\s+от\s+подписания\s+акта)"
ARBITRARY = r"(?:по\s+(?:своему|собственному)\s+усмотрению|без\s+(?:объяснения|указания)\s+(?:причин|мотивов)|мотивировать\s+отказ\s+\w*\s*не\s+обязан)"
DAMAGES = r"(?:возмеща|возмещени|убытк|ущерб|ответственност|отвеча|залал|жауапты|жауап\s+береді)"

RATE, CAP, FINE, BURDEN = column("rate"), column("cap"), column("fine"), column("burden")
DURATIONS, NOTICES, TERMS = column("durations"), column("notices"), column("terms")


def NONE() -> Column:
    return F.array().cast(HIT)


def text_has(p: str) -> Column:
    return has(TEXT(), p)


def first(p: str) -> Column:
    return F.get(spans(TEXT(), p), F.lit(0))


def marks(*found: Column) -> Column:
    """Distinct spans in order; nulls are left out."""
    plain = [F.when(s.isNotNull(), F.struct(s["start"].alias("start"), s["end"].alias("end"))) for s in found]
    return F.array_sort(F.array_distinct(F.array_compact(F.array(*plain))))


def hit(rule_id: str, level: Column, against: Column, evidence: Column, **details: Column) -> Column:
    known = F.map_filter(F.create_map(*[x for k, v in details.items() for x in (F.lit(k), v.cast("string"))]), lambda _, v: v.isNotNull()) if details else F.create_map().cast("map<string,string>")
    return F.struct(
        F.lit(rule_id).alias("rule_id"), F.lit(rule_id.split(".")[0]).alias("category"), level.cast("int").alias("level"), against.alias("against"), evidence.alias("evidence"), known.alias("details")
    )


def one(rule_id: str, level: Column, against: Column, evidence: Column, **details: Column) -> Column:
    return F.array(hit(rule_id, level, against, evidence, **details)).cast(HIT)


def each(role_of: Column, rule_id: str, level: Column, evidence: Column, **details: Column) -> Column:
    """A hit against the other party of each role."""
    return F.transform(role_of, lambda r: hit(rule_id, level, F.array(counterparty(r)), evidence, **details)).cast(HIT)


def lowered(level: Column, mutual: Column) -> Column:
    """Mutual terms weigh a level less; what was low is none."""
    return F.when(~mutual, level).when(level > LOW, level - 1)




def money(rule_id: str, level: Column, evidence: Column, **details: Column) -> Column:
    """A hit against whom the clause burdens."""
    final = lowered(level, BURDEN()["mutual"])
    return F.when(final.isNotNull() & BURDEN().isNotNull(), one(rule_id, final, BURDEN()["against"], evidence, **details))


def daily_rate() -> Column:
    r = RATE()["value"]
    level = F.when(r >= 0.5, HIGH).when(r > 0.1, MEDIUM).when(r.isNotNull() & ~F.col("capped"), LOW)
    return money("penalty.daily_rate", level, marks(RATE(), CAP()), daily_rate=r, capped=F.col("capped"), mutual=BURDEN()["mutual"])


def single_fine() -> Column:
    f = FINE()["value"]
    level = F.when(f >= 30, HIGH).when(f > 10, MEDIUM)
    return F.when(RATE().isNull() & ~text_has(TERMINATION_CONTEXT), money("penalty.fine", level, marks(FINE()), fine_percent=f))


def auto_renewal() -> Column:
    renewal, discretion, must = first(RENEWAL), first(DISCRETION), first(MUST_NOTIFY)
    setter = F.array_min(F.transform(MENTIONS(), lambda m: F.struct(F.abs(m["start"] - discretion["start"]), m["start"], m["role"])))["role"]
    longest = numbers.extreme(NOTICES(), largest=True)
    notifier = F.try_element_at(F.filter(MENTIONS(), lambda m: (m["gcase"] == "nom") & (m["start"] < must["start"])), F.lit(-1))["role"]
    notifier = F.when(must.isNotNull() & ~F.col("mutual"), notifier)
    against = F.when(notifier.isNotNull(), F.array(notifier)).otherwise(parties.both())
    agreed = text_has(BY_AGREEMENT) & ~F.lower(TEXT()).contains("автоматически")
    return F.when(
        renewal.isNotNull() & ~agreed,
        F.when(discretion.isNotNull() & text_has(PRICE) & setter.isNotNull(), one("auto_renewal.price_on_renewal", F.lit(HIGH), F.array(counterparty(setter)), marks(renewal, discretion), setter=setter))
        .when(longest["value"] >= 60, one("auto_renewal.long_notice", F.lit(MEDIUM), against, marks(renewal, longest), notice_days=longest["value"]))
        .otherwise(one("auto_renewal.silent", F.lit(LOW), parties.both(), marks(renewal))),
    )


def lost_profit() -> Column:
    over = first(OVER_PENALTY)
    return F.when(text_has(LOST_PROFIT) & ~text_has(LOST_PROFIT_EXCLUDED), money("liability.lost_profit", F.when(over.isNotNull(), HIGH).otherwise(MEDIUM), marks(first(LOST_PROFIT), over), over_penalty=over.isNotNull()))


def exclusion() -> Column:
    broad = first(BROAD)
    level = F.when(broad.isNotNull(), HIGH).otherwise(MEDIUM)

    def by(p: str) -> Column:
        return F.when(text_has(p), each(parties.released(p), "liability.exclusion", level, marks(first(p), broad), broad=broad.isNotNull()))

    return F.when(~text_has(FORCE_MAJEURE), F.when(LANG() == "kk", by(NOT_LIABLE_KK)).otherwise(by(NOT_LIABLE_RU)))


def force_majeure() -> Column:
    return F.when(text_has(FORCE_MAJEURE) & ~F.col("mutual"), each(parties.released(RELEASED), "force_majeure.one_sided", F.lit(MEDIUM), marks(first(FORCE_MAJEURE))))


def jurisdiction() -> Column:
    def there(m: Column) -> Column:
        kk = has(F.substring(TEXT(), m["end"] + 1, F.length(TEXT())), r"^\s*орналасқан\s+жері\s+бойынша")
        ru = has(before(TEXT(), m["start"], 40), r"по\s+месту\s+(?:нахождения|регистрации|жительства)\s+$")
        return (m["gcase"] == "gen") & F.when(LANG() == "kk", kk).otherwise(ru)

    located = F.get(F.filter(MENTIONS(), there), F.lit(0))
    return F.when(
        text_has(DISPUTE),
        F.when(text_has(FOREIGN), one("jurisdiction.foreign", F.lit(HIGH), parties.both(), marks(first(FOREIGN))))
        .when(text_has(AIFC), one("jurisdiction.aifc", F.lit(MEDIUM), parties.both(), marks(first(AIFC))))
        .when(located.isNotNull(), one("jurisdiction.counterparty_location", F.lit(LOW), F.array(counterparty(located["role"])), marks(located))),
    )


def unilateral_exit() -> Column:
    shortest = numbers.extreme(NOTICES(), largest=False)
    at_once = first(NO_NOTICE)
    level = (
        F.when(at_once.isNotNull(), HIGH)
        .when(text_has(BREACH) & ~text_has(VAGUE_BREACH), F.lit(None))
        .when(shortest["value"] < 30, MEDIUM)
        .when(shortest.isNull() & ~text_has(PAYS_FOR_WORK), MEDIUM)
    )
    evidence = F.when(at_once.isNotNull(), marks(at_once)).otherwise(marks(F.when(shortest["value"] < 30, shortest)))
    return F.when(level.isNotNull(), each(right_holders(TERMINATE_RU, TERMINATE_KK), "termination.unilateral", level, evidence))


def cannot_exit() -> Column:
    active, passive = first(CANNOT_EXIT), first(EXIT_BARRED)
    bound = F.when(active.isNotNull(), F.try_element_at(F.filter(MENTIONS(), lambda m: (m["gcase"] == "nom") & (m["start"] < active["start"])), F.lit(-1))["role"]).when(
        passive.isNotNull(), F.get(F.filter(MENTIONS(), lambda m: (m["start"] >= passive["start"]) & (m["start"] < passive["end"])), F.lit(0))["role"]
    )
    return F.when(bound.isNotNull(), one("termination.cannot_exit", F.lit(HIGH), F.array(bound), marks(F.coalesce(active, passive))))


def early_fee() -> Column:
    def starts(m: Column) -> Column:
        return (m["gcase"] == "gen") & (has(before(TEXT(), m["start"], 25), r"(?:по\s+(?:инициативе|желанию)|отказа|отказе)\s*$") | has(F.substring(TEXT(), m["end"] + 1, F.length(TEXT())), r"^\s*бастамасы\s+бойынша"))

    initiator = F.get(F.filter(MENTIONS(), starts), F.lit(0))["role"]
    against = F.when(initiator.isNotNull(), F.array(initiator)).when(~BURDEN()["mutual"], BURDEN()["against"])
    rest, months = first(REMAINDER), F.col("months")
    level = F.when(rest.isNotNull() | (months >= 3), HIGH).otherwise(MEDIUM)
    silent = text_has(NO_FEE) | text_has(DEPOSIT) | text_has(FORCE_MAJEURE)
    return F.when(text_has(EARLY) & text_has(FEE) & ~silent & against.isNotNull(), one("termination.early_fee", level, against, marks(first(EARLY), rest), months=months, remainder=rest.isNotNull()))


def deposit() -> Column:
    level = F.when(text_has(ANY_END), HIGH).otherwise(MEDIUM)
    return F.when((TYPE() == "lease") & text_has(DEPOSIT) & text_has(FORFEIT), one("termination.deposit_forfeit", level, F.array(F.lit("tenant")), marks(first(DEPOSIT), first(FORFEIT))))


def change() -> Column:
    terms, capped = first(CHANGE_TERMS), first(CHANGE_CAPPED)
    holders = right_holders(CHANGE_RU, CHANGE_KK)
    level = F.when(capped.isNotNull() & terms.isNull(), LOW).otherwise(HIGH)
    verb = F.when(LANG() == "kk", first(CHANGE_KK)).otherwise(first(CHANGE_RU))
    evidence = marks(verb, F.coalesce(terms, first(CHANGE_OBJECT)), first(ONE_SIDED), capped)
    return F.when(terms.isNotNull(), each(holders, "unilateral_change.terms", level, evidence, capped=capped.isNotNull())).when(text_has(CHANGE_OBJECT), each(holders, "unilateral_change.price", level, evidence, capped=capped.isNotNull()))


def payment() -> Column:
    longest = numbers.extreme(TERMS(), largest=True)
    late = text_has(PAYMENT) & ~text_has(NOT_PAYMENT) & (longest["value"] >= 60)
    return F.when(
        TYPE().isin("supply", "works"),
        F.when(text_has(PREPAID), one("payment.full_prepayment", F.lit(MEDIUM), F.array(parties.side(1)), marks(first(PREPAID))))
        .when(text_has(PAY_WHEN_PAID), one("payment.pay_when_paid", F.lit(HIGH), F.array(parties.side(0)), marks(first(PAY_WHEN_PAID))))
        .when(late, one("payment.deferral", F.when(longest["value"] >= 120, HIGH).otherwise(MEDIUM), F.array(parties.side(0)), marks(longest), days=longest["value"])),
    )


def acceptance() -> Column:
    short = F.get(F.filter(TERMS(), lambda d: d["value"] <= 3), F.lit(0))
    claims = text_has(CLAIMS) & ~text_has(HIDDEN_WARRANTY)
    return F.when(
        TYPE().isin("supply", "works"),
        F.when(text_has(REFUSAL) & text_has(ARBITRARY), one("acceptance.arbitrary_refusal", F.lit(HIGH), F.array(parties.side(0)), marks(first(REFUSAL), first(ARBITRARY)))).when(
            short.isNotNull() & (text_has(SILENT) | claims), one("acceptance.short_deadline", F.lit(MEDIUM), F.array(parties.side(1)), marks(short, F.coalesce(first(SILENT), first(CLAIMS))), days=short["value"])
        ),
    )


#: In order: what comes first wins ties of one category and level.
RULES = (daily_rate, single_fine, auto_renewal, lost_profit, exclusion, force_majeure, jurisdiction, unilateral_exit, cannot_exit, early_fee, deposit, change, payment, acceptance)


def held(df: DataFrame, **columns: Column) -> DataFrame:
    """df with columns that are computed once: a generator of one row keeps the optimizer from copying them into all that refer to them."""
    made = df.withColumn("__held", F.explode(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))
    return made.select(*[F.col(f"`{c}`") for c in df.columns], *[F.col("__held").getField(n).alias(n) for n in columns])


#: What each rule reads besides mentions and `mutual`.
NEEDS: dict[Callable[[], Column], tuple[str, ...]] = {
    daily_rate: ("rate", "cap", "capped", "burden"), single_fine: ("rate", "fine", "burden"), auto_renewal: ("notices",), lost_profit: ("burden",), unilateral_exit: ("notices",),
    early_fee: ("burden", "months"), payment: ("terms",), acceptance: ("terms",),
}
SHARED = ("rate", "fine", "cap", "capped", "notices", "terms", "months", "burden")


def analysed(clauses: DataFrame, needs: Iterable[str] = SHARED) -> DataFrame:
    """clauses (text, contract_type, lang) with mentions, mutual, and of what rules share that which is needed."""
    needs = set(needs)
    first_ = {"mentions": parties.mentions, "mutual": parties.mutual}
    if needs & {"rate", "fine", "cap", "capped"}:
        first_["percents"] = lambda: numbers.percents(TEXT())
    if needs & {"notices", "terms", "months"}:
        first_["durations"] = lambda: numbers.durations(TEXT())
    a = held(clauses, **{k: c() for k, c in first_.items()})
    caps = lambda: numbers.of_kind(F.col("percents"), "cap")
    then = {
        "payers": parties.payers,
        "rate": lambda: numbers.extreme(numbers.of_kind(F.col("percents"), "daily"), True),
        "fine": lambda: numbers.extreme(numbers.of_kind(F.col("percents"), "fine"), True),
        "cap": lambda: numbers.extreme(caps(), True),
        "capped": lambda: (F.size(caps()) > 0) | (has(TEXT(), numbers.PENALTY) & has(TEXT(), numbers.CAP_WORDS)),
        "notices": lambda: numbers.notices(TEXT(), DURATIONS()),
        "terms": lambda: numbers.terms(TEXT(), DURATIONS()),
        "months": lambda: numbers.months_amount(TEXT(), DURATIONS()),
    }
    wanted = {k: c() for k, c in then.items() if k in needs or (k == "payers" and "burden" in needs)}
    a = held(a, **wanted) if wanted else a
    return held(a, burden=parties.burden(F.col("payers"), F.col("mutual"))) if "burden" in needs else a


def hits(clauses: DataFrame, rules=RULES) -> DataFrame:
    """clauses with hits: an array over all rules, in the rules' order."""
    shared = analysed(clauses, [n for r in rules for n in NEEDS.get(r, ())])
    named = shared.select("*", *[F.coalesce(r(), NONE()).alias(f"__{r.__name__}") for r in rules])
    out = named.withColumn("hits", F.flatten(F.array(*[F.col(f"__{r.__name__}") for r in rules])))
    return out.select(*clauses.columns, "hits")


def with_type_of_role(requests: DataFrame) -> DataFrame:
    return requests.withColumn("contract_type", lookup(TYPE_OF, F.col("party_role")))


__all__ = ["HIT", "RULES", "after", "analysed", "hits", "with_type_of_role"]
