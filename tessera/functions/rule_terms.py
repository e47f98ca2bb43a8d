"""Rules as data: tables of terms, found by one automaton a task, and the first rule in order that holds.

All terms of all rules are compiled to one Aho-Corasick automaton, so a text is read once however many rules and terms there are. A term
of Latin letters counts as whole words, any other as part of the text; case doesn't matter.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import once

# Words that say nothing about what is claimed.
STOP = """a an and are as at be been by for from has have i in is it its me my of on or our the their there this to was we were with
photo photos image images picture pictures scene scenes view visible see saw notice noticed observe observed remember recall moment day later then around""".split()
# Words that stand for another one.
ALIASES = {
    "people": "person", "persons": "person", "men": "man", "women": "woman", "children": "child",
    "sitting": "sit", "seated": "sit", "standing": "stand", "walking": "walk", "holding": "hold",
    "held": "hold", "wearing": "wear", "looking": "look", "typing": "type", "playing": "play",
    "buildings": "building", "cars": "car", "trees": "tree", "boats": "boat", "balloons": "balloon",
}
# Chinese phrases and the concept that each names.
GLOSSARY = {
    "人物": "person", "人": "person", "男人": "man", "男子": "man", "女人": "woman", "女子": "woman",
    "孩子": "child", "猫": "cat", "狗": "dog", "鸟": "bird", "马": "horse", "鱼": "fish",
    "桌": "table", "椅": "chair", "电脑": "computer", "笔记本": "laptop", "键盘": "keyboard",
    "手机": "phone", "屏幕": "screen", "电视": "television", "书": "book", "杯": "cup",
    "瓶": "bottle", "盘": "plate", "食物": "food", "车": "car", "自行车": "bicycle",
    "船": "boat", "飞机": "airplane", "热气球": "balloon", "气球": "balloon", "桥": "bridge",
    "河": "river", "湖": "lake", "海": "sea", "山": "mountain", "树": "tree", "花": "flower",
    "草": "grass", "天空": "sky", "云": "cloud", "太阳": "sun", "建筑": "building",
    "房间": "room", "室内": "indoor", "室外": "outdoor", "厨房": "kitchen", "浴室": "bathroom",
    "街": "street", "道路": "road", "公园": "park", "泳池": "pool", "游泳池": "pool",
    "窗": "window", "门": "door", "灯": "light", "镜": "mirror", "床": "bed", "地板": "floor",
    "坐": "sit", "站": "stand", "走": "walk", "跑": "run", "拿": "hold", "握": "hold",
    "穿": "wear", "看": "look", "吃": "eat", "喝": "drink", "游泳": "swim", "打字": "type",
    "玩": "play", "拍摄": "camera", "拍照": "camera", "说话": "talk", "指": "point",
    "红": "red", "蓝": "blue", "绿": "green", "白": "white", "黑": "black", "黄": "yellow",
}
# Terms of each rule.
UNSUPPORTED = """friend, family, mother, father, wife, husband, daughter, son, colleague, felt, feeling, happy, sad, excited, nervous, calm, relaxed, proud, grateful,
wanted, decided, planned, intended, working, studying, waiting, preparing, because, therefore, probably, possibly, likely, perhaps, maybe, might, purpose,
suggest, suggests, suggested, hint, hinted, imply, implies, mystery, childhood, under the ice, unseen current, favorite, favourite, delicious, smell, aroma, sound, laughter,
朋友, 家人, 母亲, 父亲, 妻子, 丈夫, 女儿, 儿子, 同事, 感到, 觉得, 开心, 难过, 兴奋, 紧张, 平静, 放松, 骄傲, 感谢, 想要, 决定, 计划, 打算, 工作, 学习, 等待, 准备, 因为, 所以,
可能, 也许, 似乎, 大概, 目的, 最爱, 美味, 气味, 香味, 声音, 笑声, 小时候, 暗流, 冰层下"""
OWN_ACTIONS = "am, was, sat, stood, walked, ran, held, wore, swam, ate, drank, worked, studied, played, entered, left, arrived, travelled, traveled, waited, prepared"
OWN_ACTIONS_ZH = "坐, 站, 走, 跑, 拿, 穿, 游泳, 吃, 喝, 工作, 学习, 玩, 进入, 离开, 到达, 等待, 准备"
FIRST_PERSON = "i, me, my, we, us, our, 我, 我们, 我的, 我们的"
FIGURATIVE = "as if, as though, like a dream, seemed to whisper, time stood still, chapter of life, 仿佛, 好像一场梦, 像梦一样, 时间静止, 岁月定格, 新的篇章"
PLANNING = """the user, user wants, we need, we must, we should, let me, i should, system prompt, instruction, instructions, response, diary entry, reliable_time, verified_context, title:, start with, do not use,
let's adjust, let's write, let's craft, let's create, must not, must be, must include, must use, must write, 用户, 提示词, 系统提示, 我应该, 我们需要, 不能说, 需要写, 输出格式, 字段, 回忆录中"""
GENERIC_VISUAL = "direct visual record, directly checkable, documents visible, observable visual, 直接核查, 直接观察, 可见的人物, 可观察的环境, 画面中可见"
SPECULATION = """possibly, likely, perhaps, probably, might, maybe, appears to, seems to, working, studying, getting ready, intends, intention, purpose, because, therefore, decided, felt, happy, sad, wife, husband, daughter, son,
可能, 也许, 或许, 大概, 似乎, 应该, 工作, 学习, 准备, 打算, 想要, 为了, 因为, 所以, 导致, 决定, 感到, 开心, 难过, 妻子, 丈夫, 女儿, 儿子"""
#: A comparison with something in between, which no list of terms can say.
LIKENESS = "像[^，。！？]{0,24}一样"


def terms(text: str) -> list[str]:
    return [x.strip() for x in text.replace("\n", " ").split(",")]


TABLES: dict[str, list[str]] = {
    "planning": terms(PLANNING),
    "generic": terms(GENERIC_VISUAL),
    "unsupported": terms(UNSUPPORTED),
    "own_action": [f"i {x}" for x in terms(OWN_ACTIONS)] + [f"我{how}{x}" for how, x in itertools.product(("", "正", "在", "正在"), terms(OWN_ACTIONS_ZH))],
    "first_person": terms(FIRST_PERSON),
    "figurative": terms(FIGURATIVE),
    "speculation": terms(SPECULATION),
}


def _is_word(char: str) -> bool:
    return char == "_" or char.isalnum()


def whole_words(term: str) -> bool:
    """Whether a term counts as whole words: it begins with an ASCII letter."""
    return term[0].isascii() and term[0].isalpha()


@lru_cache(maxsize=4)
def _automaton(key: tuple[tuple[str, tuple[str, ...]], ...]):
    import ahocorasick

    rules: dict[str, set[str]] = {}
    for name, own in key:
        for term in own:
            rules.setdefault(term.lower(), set()).add(name)
    out = ahocorasick.Automaton()
    for term, names in rules.items():
        out.add_word(term, (term, sorted(names)))
    out.make_automaton()
    return out


def found_terms(text: str, tables: tuple[tuple[str, tuple[str, ...]], ...]) -> Iterator[tuple[str, str]]:
    """(rule, term) of every term in a text, borders of whole words tested; white space counts as one space."""
    low = " ".join(text.lower().split())
    for end, (term, names) in _automaton(tables).iter(low):
        begin = end + 1 - len(term)
        if whole_words(term):
            if begin and _is_word(low[begin - 1]) or _is_word(term[-1]) and end + 1 < len(low) and _is_word(low[end + 1]):
                continue
        for name in names:
            yield name, term


def with_rules(df: DataFrame, text: str, tables: dict[str, list[str]] | None = None, name: str = "rules") -> DataFrame:
    """df with rules: map of each rule that has a term in the text to its distinct terms, sorted. A null text has none."""
    key = tuple((k, tuple(v)) for k, v in (tables or TABLES).items())
    at, schema = df.columns.index(text), ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema), f"`{name}` map<string,array<string>>"])
    kind = pa.map_(pa.string(), pa.list_(pa.string()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for value in batch.column(at).to_pylist():
                own: dict[str, set[str]] = {}
                for rule, term in found_terms(value or "", key):
                    own.setdefault(rule, set()).add(term)
                out.append([(k, sorted(v)) for k, v in sorted(own.items())])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, kind)], names=[*batch.schema.names, name])

    return df.mapInArrow(run, schema)


def stem(word: Column) -> Column:
    """An alias, else the word without -ing, -ed or -s if enough is left."""
    alias, n = F.element_at(F.create_map(*itertools.chain.from_iterable((F.lit(k), F.lit(v)) for k, v in ALIASES.items())), word), F.length(word)
    cut = F.when((n > 5) & word.endswith("ing"), F.left(word, n - 3)).when((n > 4) & word.endswith("ed"), F.left(word, n - 2)).when((n > 4) & word.endswith("s"), F.left(word, n - 1)).otherwise(word)
    return F.coalesce(alias, cut)


def concepts(text: Column) -> Column:
    """Distinct concepts of a text: stems of its Latin words and numbers but STOP, and where it has Chinese, its phrases' concepts."""
    found = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("([a-z0-9]+)"), F.lit(1))
    kept = F.filter(found, lambda w: ~w.isin(STOP) & ((F.length(w) > 1) | w.rlike("^[0-9]+$")))
    pairs = F.array(*(F.struct(F.lit(p).alias("phrase"), F.lit(c).alias("concept")) for p, c in GLOSSARY.items()))
    known = F.transform(F.filter(pairs, lambda p: F.contains(text, p["phrase"])), lambda p: p["concept"])
    chinese = F.when(text.rlike("[\\x{4e00}-\\x{9fff}]"), known).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(F.transform(kept, stem), chinese))


def claim_class(claim: Column, rules: Column, creative: Column, field: Column, fallback: Column, mine: Column, evidence: Column) -> Column:
    """(class, reason) of a claim: the first of the rules in order, else how many of its concepts (mine) the evidence's concepts hold.

    rules is what with_rules found. creative: whether the text may be imaginative; field: the part of the story it stands in; fallback: whether it was written without a model.
    """
    met = lambda name: F.map_contains_key(rules, F.lit(name))
    figurative = met("figurative") | claim.rlike(LIKENESS)
    table: list[tuple[str, str, Column]] = [
        ("non_factual", "planning", met("planning")),
        ("non_factual", "transition", creative & field.startswith("transition_")),
        ("non_factual", "framing", creative & field.isin("title", "opening", "closing") & figurative),
        ("supported", "generic", fallback & met("generic")),
        ("unsupported", "unsupported", met("unsupported")),
        ("unsupported", "own_action", creative & met("own_action")),
        ("unsupported", "first_person", ~creative & met("first_person")),
        ("non_factual", "figurative", figurative & creative),
        ("unsupported", "figurative", figurative),
    ]

    def by_concepts(own: Column) -> Column:
        n, shared = F.size(own), F.size(F.array_intersect(own, evidence))
        rest = [("non_factual", "empty", n == 0), ("supported", "covered", (shared >= 0.6 * n) | ((n <= 3) & (shared >= 0.5 * n))), ("uncertain", "mixed", shared > 0), ("uncertain", "other_language", claim.rlike("[\\x{4e00}-\\x{9fff}]")), ("unsupported", "unmatched", F.lit(True))]
        return _first(rest)

    return F.coalesce(_first(table), once(mine, by_concepts))


def _first(table: list[tuple[str, str, Column]]) -> Column:
    out = F
    for kind, reason, holds in table:
        out = out.when(holds, F.struct(F.lit(kind).alias("kind"), F.lit(reason).alias("reason")))
    return out
