"""Broken prompt and response pairs: every answer gets at most one defect.

Method.
empty           nothing visible after removing invisible characters and markup, or a placeholder.
refusal         a grammar over sentences: at least one sentence declines, and all others are greetings, apologies or
                advice, so no answer is left.
copied_question greedy string tiling of the answer with the question, once per repetition: what the tiles don't cover is
                only a wrapper.
other_language  script and stop-word scores of question and answer differ; quotations, names, ids and numbers
                don't count, and a language the question asks for is the language expected.
truncated       a pushdown parser over fences, quotations, brackets, lists and markup that ends with something open,
                or a last sentence without an end, unless the answer is a bare value (a date, an amount, a name).
The checks run in this order and the first that applies names the defect.

Scale. Row-local; Python only sees the question and the distinct non-NULL answers of its batch. Tiling starts only where
enough of the answer lies in runs of the question for the share asked for, and costs at most (answer x question) per round.

Defined results. A NULL final answer is ``empty``; a NULL reference answer is no case. A NULL or blank question can't be
copied and has no language. Very long texts are read whole. Repeated rows are judged each on its own. Empty tables
give no rows.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FOUND = "sample_id bigint, field_name string, defect_type string"

# What stands for an answer that isn't there.
PLACEHOLDERS = {"n/a", "na", "n.a", "none", "null", "nil", "nan", "nul", "undefined", "unknown", "tbd", "todo", "tba", "empty", "no answer", "no response", "not available", "not applicable", "pending", "blank", "placeholder", "answer", "response", "暂无", "无", "空", "暂缺", "待定", "待补充", "待填写", "未知", "没有", "无答案", "无内容", "暂无内容", "暂无答案", "暂无数据", "暂无回答", "无回答", "略", "答案", "回答", "空白", "不适用", "未填写"}

_TAG = re.compile(r"<!--.*?-->|</?[A-Za-z][A-Za-z0-9]*(?:\s[^<>]*)?/?>|&(?:nbsp|amp|lt|gt|#\d+|#x[0-9a-f]+);", re.S | re.I)
_TAG_START = re.compile(r"</?[A-Za-z]")
_FENCE = re.compile(r"(?m)^\s*(?:```|~~~)[^\n`]*$")
_HIDDEN = re.compile("[­͏؜ᅟᅠ឴឵᠋-᠏​-‏‪-‮⁠-⁯ㅤ︀-️﻿ﾠ]")


def visible(text: str) -> str:
    return _HIDDEN.sub("", text).strip()


def is_empty(text: str) -> bool:
    bare = _FENCE.sub(" ", _TAG.sub(" ", visible(text)))
    letters = "".join(c if unicodedata.category(c)[0] in "LNM" or c == "/" else " " for c in bare)
    words = " ".join(letters.split()).strip("/ ")
    return not words or words.lower() in PLACEHOLDERS or words.lower().replace(" ", "/") in PLACEHOLDERS


# --- truncation -----------------------------------------------------------------------------------------------------

# Opening characters and what closes them.
PAIRS = {"(": ")", "（": "）", "[": "]", "【": "】", "{": "}", "《": "》", "〈": "〉", "「": "」", "『": "』", "“": "”", "〔": "〕", "［": "］"}
CLOSERS = set(PAIRS.values())
WIDE = {"（": ")）", "(": ")）", "[": "]］", "［": "]］", "【": "】", "{": "}", "《": "》", "〈": "〉", "「": "」", "『": "』", "“": "”\"", "〔": "〕"}
ENDERS = "。！？.!?"
_ITEM = re.compile(r"^\s*(?:\d{1,3}[.)、．]|[-*•·]|[（(]\d{1,3}[)）])\s*")
_BARE_ITEM = re.compile(r"^\s*(?:\d{1,3}[.)、．]|[-*•·]|[（(]\d{1,3}[)）])\s*$")


def open_at_end(text: str) -> list[str]:
    """The stack of a pushdown parser at the end of the text: fences, code spans, quotations, brackets, markup."""
    stack: list[str] = []
    i, n = 0, len(text)
    last_close = max(text.rfind(">"), text.rfind("\n"))
    while i < n:
        if text.startswith("```", i):
            if stack and stack[-1] == "```":
                stack.pop()
            elif "```" not in stack:
                stack.append("```")
            i += 3
            continue
        c = text[i]
        if stack and stack[-1] == "```":
            i += 1
            continue
        if c == "`":
            stack.pop() if stack and stack[-1] == "`" else stack.append("`")
        elif c == '"':
            if stack and stack[-1] in ('"', "“"):
                stack.pop()
            elif i and text[i - 1].isdigit():
                pass  # inches
            else:
                stack.append('"')
        elif c in PAIRS:
            stack.append(c)
        elif c in CLOSERS or c in "］":
            for k in range(len(stack) - 1, -1, -1):
                if c in WIDE.get(stack[k], ""):
                    del stack[k:]
                    break
        elif c == "<":
            m = _TAG.match(text, i)
            if m:
                tag = m[0]
                name = re.match(r"</?([A-Za-z][A-Za-z0-9]*)", tag)
                if name and tag.startswith("</"):
                    mark = f"<{name[1].lower()}"
                    if mark in stack:
                        del stack[len(stack) - 1 - stack[::-1].index(mark) :]
                elif name and not tag.endswith("/>") and name[1].lower() not in ("br", "hr", "img", "li", "p", "td", "tr"):
                    stack.append(f"<{name[1].lower()}")
                i = m.end()
                continue
            if i > last_close and _TAG_START.match(text, i):  # a tag that nothing closes
                return [*stack, "<"]
        i += 1
    return stack


_DATE = re.compile(r"^(?:\d{4}\s*[年./-]\s*\d{1,2}\s*[月./-]\s*\d{1,2}\s*日?|\d{1,2}\s+[A-Z][a-z]+\s+\d{4}|[A-Z][a-z]+\s+\d{1,2},\s*\d{4}|\d{4}年(?:\d{1,2}月)?)$")
# A number with a unit: signs, or a short noun behind it.
_AMOUNT = re.compile(r"^(?:[约共计]|about |approx\. ?)?[¥$€£]?\s*\d[\d,.]*\s*(?:[%％‰]|(?P<unit>[^\W\d_]{1,12}(?:\s[^\W\d_]{1,12})?))?(?:\s*(?:per \w+|每\w))?$", re.I)
_YES = re.compile(r"^(?:yes|no|可以|不可以|是|否|不是|能|不能|对|不对|有|没有|是的|正确|错误|会|不会|true|false)$", re.I)
_CODE = re.compile(r"^[A-Z]{1,4}(?:[-/ ][A-Z0-9]+)+(?:\s*\d+)*$")
# A name in Latin letters: capitalised words, with connectives and legal forms in small letters between or behind them.
_LATIN_NAME = re.compile(r"^[A-ZÀ-Þ][\w'’&.-]*(?:\s+(?:[A-ZÀ-Þ&][\w'’&.-]*|of|and|the|de|du|des|la|von|für|y|e|plc|mbh))*$")
# Chinese verbs, prepositions, conjunctions and particles; a name of Han characters has none of them.
_HAN_CLAUSE = re.compile(r"[，,、；;：:。的为在由须可是与将被已向于按从及并至不需凭了或若则且就对把使让给]|应(?!站|链|商|中心)")
MOST_HAN, MOST_WORDS = 24, 6


def is_value(text: str) -> bool:
    """A bare value, complete without an end of sentence."""
    t = text.strip()
    if _DATE.match(t) or _YES.match(t) or _CODE.match(t):
        return True
    amount = _AMOUNT.match(t)
    if amount:
        unit = amount["unit"] or ""
        return not any(w.lower() in _WORDS["en"] - {"per"} for w in unit.split()) and not _HAN_CLAUSE.search(unit)
    if re.fullmatch(r"[一-鿿·]+", t):
        return len(t) <= MOST_HAN and not _HAN_CLAUSE.search(t)
    return len(t.split()) <= MOST_WORDS and bool(_LATIN_NAME.match(t)) and not any(w.lower() in _WORDS["en"] for w in t.split()[1:] if w[0].isupper())


# Words and characters that don't end a list item, since something has to follow them.
_DANGLING = re.compile(r"(?:(?<![\w-])(?:a|an|the|of|and|or|to|is|are|was|were|be|for|at|from|with|within|into|until|upon|which|whose|than|that|if|must|shall|will|as|its|their|per|und|oder|der|die|das|mit|für|von|zur|zum|et|ou|des|du|les|pour|avec|el|los|las|del|para|con)|[的及或从将被把按是于须且]|应[在由向为当]|不得)$", re.I)


def is_truncated(text: str) -> bool:
    t = visible(text)
    if not t:
        return False
    stack = open_at_end(t)
    if stack:
        return True
    if re.search(r"(?:…|\.{3,}|。{3,})[”\"』」）)】\]]*$", t):
        return True
    last = t.rsplit("\n", 1)[-1]
    if _BARE_ITEM.match(last):
        return True
    end = t.rstrip("”\"』」’'*_`~ \n")
    if not end:
        return False
    if end[-1] in ENDERS:
        return False
    if end[-1] in ")）]】》}>":
        return False
    if "\n" not in t and is_value(t):
        return False
    if re.search(r"\|\s*$", last) and last.lstrip().startswith("|"):
        return False
    lines = [x for x in t.split("\n") if x.strip()]
    if len(lines) > 1 and _ITEM.match(last):  # a list whose other items end without a stop either
        others = [x for x in lines[:-1] if _ITEM.match(x)]
        if others and all(x.rstrip()[-1] not in ENDERS + ";；" for x in others) and not re.search(r"[，、,;；:：(（-]$", last.rstrip()):
            return bool(_DANGLING.search(end)) or len(last) < 0.3 * min(len(x) for x in others)
    return True


# --- refusals -------------------------------------------------------------------------------------------------------

_SENTENCE = re.compile(r"[^。！？!?\n;；]+?(?:[。！？!?;；\n]+|\.(?=\s|$)|$)")
_POLITE = re.compile(
    r"^(?:(?:非常|十分|很|实在)?(?:抱歉|遗憾|对不起|不好意思)(?:让您久等)?|您好|你好|谢谢(?:您)?(?:的(?:提问|理解))?|感谢(?:您)?的?(?:提问|理解)?|(?:i'?m |i am |we are |we'?re )?(?:very |so |really )?sorry(?: for .{0,40}| about .{0,40})?|(?:my |our |please accept my )?apologies|i apologi[sz]e|unfortunately|regrettably|hello|hi|dear user|thank you(?: for .{0,40})?|thanks)$",
    re.I,
)
_ADVICE = re.compile(
    r"(?:请|建议|您可以|可以|欢迎|如有|如需|如果您|若您|麻烦|推荐)(?:您)?.{0,12}(?:换个|重新|再试|联系|咨询|查阅|查看|参考|提供|补充|提问|询问|核实|确认|尝试|人工|客服|上传)|如有其他问题|欢迎继续|请换|请再|^(?:please |kindly |you (?:may|can|could|might) |feel free |i (?:suggest|recommend)|try |let me know|if you (?:have|need|can)|for (?:further|more) )|please (?:ask|contact|check|try|consult|rephrase|provide|refer|reach)|happy to help|another question|anything else",
    re.I,
)


def _any(words: str) -> str:
    """One of the words or word patterns of a list set apart by blanks; ``_`` stands for a blank inside one."""
    return "(?:" + "|".join(w.replace("_", " ") for w in words.split()) + ")"


# The refusal grammar. A clause declines if it is
#   subject (gap) negated-modal (gap) act      "I cannot (really) answer", "目前 无法 回答"
#   subject (gap) ignorance                    "I am not sure", "我 不清楚"
#   subject (gap) lack (gap) ground            "we have no information", "没有 相关资料"
#   source (gap) negated-verb (gap) content    "the documents do not contain"
#   impersonal                                 "cannot be answered", "outside my scope"
# The words of each part.
ZH_SUBJECT = "我 本助手 作为.{0,10}(?:助手|模型|AI|系统) 目前 现有 当前 暂时 这个 该问题 系统 很遗憾 抱歉 对不起 不好意思 ^"
ZH_ACT = "回答 提供 给出 判断 确定 解答 告诉 回复 评论 评价"
ZH_UNABLE = "作答 确认 查询 查看 访问 得知 协助 处理"
ZH_IGNORANCE = "不(?:太)?(?:清楚|知道|了解|确定) 不便(?:回答|透露|评论|评价|提供) 不足以(?:支持|回答|判断|给出|得出) 难以(?:回答|判断|给出|确定) 拒绝回答 无(?:权|可奉告) 超出.{0,12}(?:范围|能力) 不在.{0,10}范围"
ZH_GROUND = "权限 资格 足够 找到 查到 检索到 覆盖 包含 提到 提及 涉及 相关(?:信息|资料|内容|片段|记录)"
ZH_SOUGHT = "检索到 找到 查到 查询到 能找到 能检索 提供 提及 包含 覆盖 涉及"
_DECLINE = re.compile(
    _any(ZH_SUBJECT) + ".{0,24}?(?:"
    + f"无法{_any(ZH_ACT + ' ' + ZH_UNABLE)}|(?:没有?办法|没法|不能){_any(ZH_ACT)}|不能(?:作出|做出|对.{{0,30}}(?:作出|做出|发表|给出|评论|评价|判断))|"
    + f"{_any(ZH_IGNORANCE)}|没有{_any(ZH_GROUND)}|未{_any(ZH_SOUGHT)}.{{0,20}}|无相关(?:信息|资料|内容))",
    re.I,
)
EN_SUBJECT = "i we the_assistant this_assistant"
EN_NEGATED = "do_not don'?t cannot can'?t can_not could_not couldn'?t am_unable are_unable '?m_unable am_not_able '?m_not_able are_not_able '?m_afraid_i won'?t will_not would_not wouldn'?t must_decline have_to_decline decline prefer_not have_no lack am_not_sure '?m_not_sure am_not_allowed '?m_not_allowed am_not_authori[sz]ed '?m_not_authori[sz]ed am_not_permitted '?m_not_permitted did_not_find didn'?t_find found_no find_no"
EN_ACT = "know answer help assist say tell provide access find determine comment information confirm share discuss give have respond reply judge permission that this able sure idea see look"
EN_SOURCE = "context documents? knowledge_base sources? passages? material information excerpts?"
EN_HOLDS_NOT = "does_not do_not doesn'?t don'?t did_not is_not isn'?t are_not aren'?t"
EN_CONTENT = "contain cover include mention support provide enough sufficient say hold address answer"
EN_GROUND = "information passages? context documents? results? records? excerpts? answers?"
EN_IMPERSONAL = "it_(?:would_not|wouldn'?t|is_not)_(?:be_)?appropriate not_able_to_answer unable_to_(?:answer|provide|help|assist|determine|comment|find) can(?:not|'?t)_be_answered cannot_answer can'?t_(?:answer|help|say) (?:insufficient|not_enough)_(?:context|information) nothing_(?:relevant|suitable|in_the)[^.!?]{0,40}(?:found|retrieved|answers|covers)? (?:outside|beyond)_(?:my|the)_(?:scope|knowledge|remit)"
_DECLINE_EN = re.compile(
    rf"\b{_any(EN_SUBJECT)}\b[^.!?]{{0,40}}?\b{_any(EN_NEGATED)}(?: be able)?\b(?:[^.!?]{{0,30}}\b{_any(EN_ACT)}\b|(?=[.!?]|$))|"
    rf"\b(?:{_any(EN_SOURCE)}[^.!?]{{0,40}}{_any(EN_HOLDS_NOT)}[^.!?]{{0,20}}{_any(EN_CONTENT)}|"
    rf"no (?:relevant |matching |such |sufficient )?{_any(EN_GROUND)} (?:is |are |was |were |could |can )?(?:available|found|retrieved|returned|be found|in the)|{_any(EN_IMPERSONAL)})\b",
    re.I,
)
OTHER_DECLINES = "ich_kann_(?:diese|die|das|dazu|hierzu|leider)[^.]{0,40}nicht kann_ich_nicht ich_weiß_(?:es_)?nicht keine_(?:informationen|angaben) nicht_beantworten je_ne_(?:peux|sais|dispose|suis)[^.]{0,30}pas impossible_de_répondre aucune_information no_puedo_(?:responder|ayudar|contestar) no_lo_sé no_tengo_(?:acceso|información)"
_DECLINE_OTHER = re.compile(rf"\b{_any(OTHER_DECLINES)}\b", re.I)
_CLAUSE = re.compile(r"[，,]\s*|\s[-–—]+\s|\s*——\s*|：|:\s")


# Numbers in identifiers (capitals and figures joined by hyphens) state nothing.
_IDENTIFIER = re.compile(r"[A-Z]+[A-Z0-9]*(?:-[A-Z0-9]+)+")


def _declines(s: str) -> bool:
    return bool(_DECLINE.search(s) or _DECLINE_EN.search(s) or _DECLINE_OTHER.search(s))


def is_refusal(text: str) -> bool:
    """Some sentence declines, and nothing else but courtesy and advice is said."""
    t = visible(text)
    if not _declines(t):
        return False
    said = False
    for m in _SENTENCE.finditer(t.replace("’", "'")):
        s = m[0].strip(" \t\n。！？!?;；.")
        if not s:
            continue
        clauses = [c.strip() for c in _CLAUSE.split(s) if c.strip()]
        if all(_POLITE.match(c) for c in clauses):
            continue
        if _declines(s):
            # a sentence that declines one thing may still state another: a number or a stated rule speaks for an answer
            rest = [c for c in clauses if not (_declines(c) or _POLITE.match(c) or _ADVICE.search(c) or len(c) < 24 or re.match(r"(?:也|so|and|as an?|作为|关于|regarding|about)", c, re.I))]
            if any(re.search(r"\d", _IDENTIFIER.sub("", c)) for c in rest):
                return False
            said = True
        elif not _ADVICE.search(s):
            return False
    return said


# --- copied questions -----------------------------------------------------------------------------------------------

_UNIT = re.compile(r"[A-Za-zÀ-ɏЀ-ӿ]+(?:['’][a-z]+)?|\d+|[^\W\d_]")
# Words around a repeated question that say nothing themselves.
_WRAPPER = re.compile(r"(?:您|你)(?:问的|的问题|的提问|想问的|想知道的|刚才问的|咨询的|想了解(?:的)?|想问|想知道)(?:是|为|就是)?|问题(?:是|为|如下)?[：:]|关于(?:您|你)的问题|用户(?:问|提问|的问题)(?:是|为)?|您好|你好|以下是(?:您|你)?的?问题|\b(?:you asked|your question (?:was|is|reads)?|the question (?:was|is)|question|user asked|you (?:want|would like) to know|you are asking|asked|q)\b\s*[:：]?|^\s*>", re.I | re.M)
MIN_TILE = 3


def tile_cover(answer: list[str], question: list[str], least: int = MIN_TILE, times: int = 1) -> int:
    """Units of the answer covered by greedy string tiling with the question (longest common runs first, no overlap).

    Each unit of the question is used ``times`` times at most.
    """
    free_a, left_q = [True] * len(answer), [times] * len(question)
    where: dict[str, list[int]] = {}
    for j, u in enumerate(question):
        where.setdefault(u, []).append(j)
    covered = 0
    while True:
        best, tiles = least, []
        i = 0
        while i < len(answer):
            if free_a[i]:
                for j in where.get(answer[i], ()):
                    if i and j and free_a[i - 1] and left_q[j - 1] and answer[i - 1] == question[j - 1]:
                        continue  # within a longer run, seen at its start
                    k = 0
                    while i + k < len(answer) and j + k < len(question) and answer[i + k] == question[j + k] and free_a[i + k] and left_q[j + k]:
                        k += 1
                    if k > best:
                        best, tiles = k, [(i, j)]
                    elif k == best:
                        tiles.append((i, j))
            i += 1
        if not tiles:
            return covered
        for i, j in tiles:
            if all(free_a[i : i + best]) and all(left_q[j : j + best]):
                free_a[i : i + best] = [False] * best
                left_q[j : j + best] = [n - 1 for n in left_q[j : j + best]]
                covered += best


def _coverable(answer: list[str], question: list[str], least: int) -> int:
    """Units of the answer that lie in some run of ``least`` units of the question: no tiling covers more."""
    runs = {tuple(question[j : j + least]) for j in range(len(question) - least + 1)}
    n = end = 0
    for i in range(len(answer) - least + 1):
        if tuple(answer[i : i + least]) in runs:
            n += i + least - max(i, end)
            end = i + least
    return n


def is_copied(answer: str, question: str, share: float = 0.82) -> bool:
    """The answer is the question, once or several times, in a wrapper at most.

    Under 0.4 of the question is no copy of it but a choice it names; an answer of under 4 units has to be the whole of a
    question as short.
    """
    q = [u.lower() for u in _UNIT.findall(question)]
    said = visible(answer)
    for text in dict.fromkeys((_WRAPPER.sub(" ", said), said)):  # a short question may itself read like a wrapper
        a = [u.lower() for u in _UNIT.findall(text)]
        if not a or not q or len(a) < (share if len(a) < 4 else 0.4) * len(q):
            continue
        least, times = min(MIN_TILE, len(q)), math.ceil(share * len(a) / len(q))  # fewer copies can't cover the share
        if _coverable(a, q, least) >= share * len(a) and tile_cover(a, q, least, times) >= share * len(a):
            return True
    return False


# --- languages ------------------------------------------------------------------------------------------------------

# Articles, pronouns, prepositions, conjunctions, auxiliaries and particles of each language, as stop-word lists
# hold them; a word of two languages counts for both.
FUNCTION_WORDS = {
    "en": "a an the this that these those it its he she they them their we you your i my our who whom whose which what when where why how all any both each few more most other some such no nor not only own same so than too very of at by for with about against between into through during before after above below to from up down in out on off over under again further then once here there and but if or because as until while is am are was were be been being have has had having do does did doing can could will would shall should may might must within without upon per least less yes",
    "de": "der die das den dem des ein eine einer eines einem einen und oder aber nicht kein keine ist sind war waren wird werden wurde hat haben kann können muss müssen soll sollen darf in im an am auf von vom zu zum zur mit für nach bei bis aus ab vor über unter um durch gegen ohne als wie wenn weil dass ob sich es er sie wir ihr man nur noch auch schon sowie innerhalb sonst wer was wo wann",
    "fr": "le la les l un une des du de d et ou mais ne pas est sont était sera être a ont avoir au aux en dans par pour sur sous avec sans ce cet cette ces il elle ils elles on nous vous qui que quoi dont où si plus moins très tout tous doit peut avant après pendant entre chez comme quand y à",
    "es": "el la los las lo un una unos unas y o u pero no es son era será ser ha han haber en de del al a por para con sin sobre entre hasta desde se su sus le les que quien cual cuando donde como si más menos muy todo todos debe puede antes después durante contra este esta estos estas ya",
    "ru": "и в во не что он на я с со как а то все она так его но да ты к у же вы за бы по только ее мне было вот от меня еще нет о из ему когда даже ну ли если уже или ни быть был него до вас при для это эта этот их чем без после под над через между должен может",
}
_WORDS = {lang: set(words.split()) for lang, words in FUNCTION_WORDS.items()}
_HAN = re.compile(r"[㐀-䶿一-鿿豈-﫿]")
# Characters that occur in Chinese sentences, seldom in names.
_HAN_FUNCTION = re.compile(r"[的了是在为不有和与或及以由于从到对将应须可能会把被按自前后内外上下起至若如则且并者其该此这那个日年月天元期第条款项超过后由]")
_KANA, _HANGUL = re.compile(r"[぀-ヿ]"), re.compile(r"[가-힯]")
_WORD = re.compile(r"[A-Za-zÀ-ɏЀ-ӿ]+")
_QUOTED = re.compile(r"“[^”]*”|「[^」]*」|『[^』]*』|《[^》]*》|\"[^\"\n]*\"|【[^】]*】|`[^`]*`|«[^»]*»|„[^“”]*[“”]")
_ASKED = [
    ("en", re.compile(r"(?:用|以|使用|改用|给出|提供)\s*(?:英文|英语)|英文(?:作答|回答|回复)|英语(?:作答|回答|回复)|\b(?:in|use) english\b|auf englisch|en anglais|en inglés", re.I)),
    ("zh", re.compile(r"(?:用|以|使用|改用|给出|提供)\s*(?:中文|汉语|简体)|中文(?:作答|回答|回复)|\b(?:in|use) (?:simplified )?(?:chinese|mandarin)\b|auf chinesisch|en chinois|en chino", re.I)),
    ("de", re.compile(r"(?:用|以)\s*(?:德文|德语)|\b(?:in|use) german\b|auf deutsch|en allemand|en alemán", re.I)),
    ("fr", re.compile(r"(?:用|以)\s*(?:法文|法语)|\b(?:in|use) french\b|auf französisch|en français|en francés", re.I)),
    ("es", re.compile(r"(?:用|以)\s*(?:西班牙文|西班牙语)|\b(?:in|use) spanish\b|auf spanisch|en espagnol|en español", re.I)),
    ("ru", re.compile(r"(?:用|以)\s*(?:俄文|俄语)|\b(?:in|use) russian\b|auf russisch|en russe|en ruso|по-русски", re.I)),
]


def language(text: str) -> str | None:
    """The language of the sentences of a text; None where only names, numbers or quotations are left."""
    bare = _QUOTED.sub(" ", text)
    if not re.search(r"\w", re.sub(r"[\d_]", "", bare)):
        return None
    han = len(_HAN.findall(bare))
    function_han = len(_HAN_FUNCTION.findall(bare))
    words = [w for w in _WORD.findall(bare)]
    lower = [w.lower() for w in words]
    scores = {lang: sum(w in known for w in lower) for lang, known in _WORDS.items()}
    if len(_KANA.findall(bare)) > 2:
        return "ja"
    if len(_HANGUL.findall(bare)) > 2:
        return "ko"
    cyrillic = sum(1 for w in lower if "а" <= w[0] <= "ё")
    if cyrillic >= 3 and cyrillic > 0.5 * len(words):
        return "ru"
    common = sum(1 for w in words if w.islower())  # names are capitalised
    best = max(scores, key=lambda k: scores[k])
    latin = max(scores[best], 0)
    if latin >= 2 and latin + 0.5 * common > function_han:
        return best
    if function_han >= 2 and function_han >= latin:
        return "zh"
    if han >= 4 and han > 2 * len(words):
        return "zh" if function_han else None
    return None


def asked_language(question: str) -> str | None:
    asked = [(m.start(), lang) for lang, p in _ASKED for m in p.finditer(question)]
    return max(asked)[1] if asked else None


def is_other_language(answer: str, question: str) -> bool:
    want = asked_language(question) or language(question)
    got = language(answer)
    return want is not None and got is not None and want != got


def defect(answer: str | None, question: str | None) -> str | None:
    """The one defect of an answer, or None."""
    if answer is None or is_empty(answer):
        return "empty"
    if is_refusal(answer):
        return "refusal"
    if question and is_copied(answer, question):
        return "copied_question"
    if question and is_other_language(answer, question):
        return "other_language"
    return "truncated" if is_truncated(answer) else None


def defects(samples: DataFrame, key: str = "sample_id", question: str = "question", fields: tuple[str, ...] = ("final_answer", "reference_answer"), null_is_case: tuple[str, ...] = ("final_answer",)) -> DataFrame:
    """(sample_id, field_name, defect_type): one row per defective answer."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            out = []
            for f in fields:
                for k, q, a in zip(part["key"], part["question"], part[f]):
                    if a is None and f not in null_is_case:
                        continue
                    d = defect(a, q)
                    if d:
                        out.append((k, f, d))
            yield pd.DataFrame(out, columns=["sample_id", "field_name", "defect_type"])

    return samples.select(F.col(key).cast("bigint").alias("key"), F.col(question).alias("question"), *fields).mapInPandas(run, FOUND)
