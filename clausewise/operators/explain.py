"""What a reader is told of a finding: title, explanation, advice, safer wording, legal reference. Added last, when one finding of a kind is left."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clausewise.dims import CATEGORY_TITLES, LEGAL, LEVEL_ADVICE, lookup

#: rule -> title, explanation, safer wording, key of the legal reference.
TEXTS: dict[str, tuple[str, str, str | None, str | None]] = {
    "penalty.daily_rate": ("Высокая пеня за каждый день", "Пеня начисляется ежедневно; без потолка она может превысить сам долг.", "Пеня 0,1% за каждый день просрочки, но не более 10% суммы долга.", "penalty_reduction"),
    "penalty.fine": ("Крупный разовый штраф", "Штраф взимается сразу и не зависит от длительности нарушения.", "Штраф не более 10% стоимости, зачётный к убыткам.", "penalty_reduction"),
    "auto_renewal.price_on_renewal": ("Продление с новой ценой", "Договор продлевается сам, а цену устанавливает другая сторона.", "При продлении цена меняется только по соглашению Сторон.", "adhesion"),
    "auto_renewal.long_notice": ("Долгий срок отказа от продления", "Отказаться от продления нужно очень заранее; срок легко пропустить.", "Уведомление об отказе от продления — за 30 дней.", None),
    "auto_renewal.silent": ("Автоматическое продление", "Договор продлевается сам, если никто не возразил.", "Договор продлевается по письменному соглашению Сторон.", None),
    "liability.lost_profit": ("Возмещение упущенной выгоды", "Кроме прямого ущерба взыскивается доход, который другая сторона могла получить.", "Возмещается прямой ущерб; упущенная выгода возмещению не подлежит.", None),
    "liability.exclusion": ("Контрагент снимает с себя ответственность", "Другая сторона не отвечает за свои нарушения, и взыскать ущерб будет трудно.", "Стороны несут ответственность на равных условиях.", "adhesion"),
    "force_majeure.one_sided": ("Форс-мажор только для одной стороны", "При непреодолимой силе освобождается лишь другая сторона.", "Обе Стороны освобождаются от ответственности при непреодолимой силе.", "force_majeure"),
    "jurisdiction.foreign": ("Споры за границей или по чужому праву", "Защита прав потребует расходов в другой стране.", "Споры рассматривает суд по месту нахождения ответчика.", None),
    "jurisdiction.aifc": ("Споры в международном центре", "Разбирательство идёт на английском языке и стоит дороже.", "Споры рассматривает суд по месту нахождения ответчика.", None),
    "jurisdiction.counterparty_location": ("Суд по месту контрагента", "Судиться придётся там, где удобно другой стороне.", "Споры рассматривает суд по месту нахождения ответчика.", None),
    "termination.unilateral": ("Выход контрагента без достаточного предупреждения", "Другая сторона может прекратить договор почти сразу.", "Каждая Сторона вправе отказаться от Договора, предупредив за 30 дней.", "unilateral_refusal"),
    "termination.cannot_exit": ("Вы не можете выйти досрочно", "Прекратить договор до конца срока нельзя.", "Каждая Сторона вправе отказаться от Договора, предупредив за 30 дней.", "unilateral_refusal"),
    "termination.early_fee": ("Плата за досрочный выход", "За прекращение договора по вашей инициативе нужно платить.", "При досрочном отказе компенсация не превышает платы за один месяц.", None),
    "termination.deposit_forfeit": ("Обеспечение не возвращается", "Внесённая сумма остаётся у другой стороны.", "Обеспечительный платёж возвращается за вычетом доказанного ущерба.", None),
    "unilateral_change.price": ("Цену меняет одна сторона", "Стоимость может вырасти без вашего согласия.", "Цена меняется только дополнительным соглашением Сторон.", "adhesion"),
    "unilateral_change.terms": ("Условия меняет одна сторона", "Правила договора могут измениться без вашего согласия.", "Условия меняются только дополнительным соглашением Сторон.", "adhesion"),
    "payment.full_prepayment": ("Полная предоплата", "Деньги уходят раньше, чем выполнено обязательство.", "Предоплата 30%, остаток после исполнения.", None),
    "payment.pay_when_paid": ("Оплата после денег третьего лица", "Вам платят, только когда заплатят контрагенту.", "Оплата в течение 10 дней после приёмки.", None),
    "payment.deferral": ("Долгая отсрочка оплаты", "Деньги поступят нескоро, и вы кредитуете другую сторону.", "Оплата в течение 30 дней.", None),
    "acceptance.arbitrary_refusal": ("Отказ от приёмки без причин", "Результат могут не принять по усмотрению другой стороны.", "Отказ от приёмки — только с письменным перечнем недостатков.", None),
    "acceptance.short_deadline": ("Короткий срок на претензии", "Проверить результат и заявить о недостатках можно не успеть.", "Срок проверки и претензий — 10 рабочих дней.", None),
    "document.force_majeure_missing": ("В договоре нет пункта о форс-мажоре", "Не определено, как уведомлять о непреодолимой силе, чем её подтверждать и когда можно выйти из договора.", "Стороны освобождаются от ответственности при непреодолимой силе, уведомив друг друга в течение 5 рабочих дней.", "force_majeure"),
    "document.liability_one_sided": ("Ответственность в договоре только у вас", "За нарушения платите только вы; с контрагента убытки придётся взыскивать отдельно.", "Виновная Сторона уплачивает другой пеню 0,1% за каждый день, но не более 10%.", None),
    "ml": ("Пункт похож на рискованные формулировки", "Это статистическая оценка без точного правила — проверьте пункт сами.", None, None),
}
DISCLAIMER = "Это автоматический первичный скрининг, а не юридическое заключение: пункт может быть пропущен или оценён неверно. Перед подписанием договора на существенную сумму покажите его юристу."


def text_of(rule: Column, i: int) -> Column:
    return lookup({k: t[i] for k, t in TEXTS.items() if t[i] is not None}, rule)


def told(of: Callable[[str], Column]) -> list[Column]:
    """title, explanation, advice, safer_wording and legal_basis of a finding whose columns `of` names."""
    rule = of("rule_id")
    legal = lookup({k: LEGAL[t[3]] for k, t in TEXTS.items() if t[3]}, rule)
    why = F.concat_ws(" ", F.when(of("source") == "ml", F.concat(F.lit("Вероятность риска для вас "), F.bround(100 * of("confidence")).cast("int").cast("string"), F.lit("%."))), F.coalesce(text_of(rule, 1), F.try_element_at(of("details"), F.lit("explanation"))))
    return [
        F.coalesce(text_of(rule, 0), lookup(CATEGORY_TITLES, of("category"))).alias("title"), why.alias("explanation"), lookup(LEVEL_ADVICE, of("level")).alias("advice"),
        F.coalesce(text_of(rule, 2), F.try_element_at(of("details"), F.lit("safer_wording"))).alias("safer_wording"), legal.alias("legal_basis"),
    ]


def explained(found: DataFrame) -> DataFrame:
    """Findings with title, explanation, advice, safer_wording and legal_basis; a rule without texts is titled by its category."""
    return found.select("*", *told(F.col))
