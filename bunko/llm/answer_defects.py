"""Problem 3: defective answers and evidences, by tagging their clauses with a conditional random field.

A response is cut into clauses at sentence ends and line breaks. A linear-chain conditional random field tags each as
answer, refusal, echo (of the question), foreign (another language than wanted) or unfinished. A field's defect follows
from how much of the response the clauses of each tag cover:

* empty: no visible character, or nothing but a placeholder (answer only);
* refusal: refusals cover at least half;
* copy: echoes cover at least half, and answer clauses less than a quarter;
* other_language: foreign clauses cover more than answer clauses;
* truncated: the last clause is unfinished.

At most one defect per field, the first of these that holds. What the field sees of a clause says nothing of defects by
itself: its place and length, the share of its character pairs that the question has and the reverse, digits that are
new, how it ends, its brackets, whether it is an entry of a list, and the log odds of its characters under models of runs
of one to four characters: of the languages (how much better the question's, or one that the question asks for, explains
the running words than all others), of clauses that decline against others, with and without what stands in quotes, and
of the ends of cut texts against whole ones.

No labels are read. Models and field are fitted here, on the driver, from the TRAIN_ROWS rows that come first by hash, a
bound of the fit only: responses as they are, taken as sound though some are not, and each changed so that its tags are
known: cut off at a random place, replaced by the question in some frame, by sentences that decline, by a response to a
question of another language. Then the field tags the sample's own responses, and all is fitted once more without those
that look defective and with clauses that decline for certain (SURE), so that phrases of the table are learned which the
sentences given here don't have. Of a response of more than TRAIN_CLAUSES clauses the last ones are used to fit. The
weights of the field start from nothing; a table without rows to fit on has no defect but `empty`. Every row is tagged.

A null answer is empty; a null or empty evidence is no defect; a null or empty question makes neither echo nor foreign.
Table `ask_cache` rows repeat; each counts for itself.
"""

from __future__ import annotations

import random
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bunko.llm.lookalike import consistent_form
from bunko.session import spread, table

TAGS = ["answer", "refusal", "echo", "foreign", "unfinished"]
ANSWER, REFUSAL, ECHO, FOREIGN, UNFINISHED = range(5)
LANGUAGES = ["en", "ja", "de", "zh"]
TRAIN_ROWS = 1000
TRAIN_CLAUSES = 12
ROUNDS = 120
SURE = 0.95
BUCKETS = 1 << 18
BATCH = 2000

# What stands for nothing.
PLACEHOLDERS = frozenset(
    "null none nil nan n/a na n.a. - -- --- – — … ... .. . \"\" '' `` ? ？ / // （空） (空) 空 （空欄） 空欄 なし 無し 該当なし 未回答 未記入 不明 无 無 空白 暂无 没有 tbd todo undefined empty (empty) [empty] (none) [] {} () 「」 _ __ ___ * x xx xxx".split()
)
# Frequent words of two languages that share their letters, to name the language of training texts.
WORDS = {"en": frozenset("the of and to are what which who how many does by please were has with from not".split()), "de": frozenset("der die das und den mit von für auf ist im wie viele wer hat zu dem bei wann wird wurde nicht".split())}
# Names of languages in a question that asks for one.
_ASKS = {"en": re.compile("英語|英文|English|Englisch|用英"), "ja": re.compile("日本語|Japanese|Japanisch|日[语文]"), "de": re.compile("ドイツ語|German|Deutsch|用德"), "zh": re.compile("中国語|Chinese|Chinesisch|中文|汉语")}
_CLAUSE = re.compile(r"[^。！？!?\n．.]*(?:[。！？!?．]+|\.+(?=\s|$|[」』”\"*)])|\.|\n|$)[」』”\"*`）)]*\s*")
_ITEM = re.compile(r"^\s*(?:[-*・•■□+]|\(?\w{1,3}[.)])\s")
_QUOTED = re.compile(r"「[^」]*」|『[^』]*』|“[^”]*”|„[^“”]*[“”]|\"[^\"]*\"|«[^»]*»")
# Running words: words in small letters that are no part of a name, hiragana and ideographs.
_RUNNING = re.compile(r"(?<![A-Za-zÀ-ÿ0-9_.])[a-zà-ÿ]+(?![A-Za-z0-9_]|\.\w)|[ぁ-ゖ一-龥々]+")
_BARE = re.compile(r"[\W_]+")
_DIGITS = re.compile(r"\d")
# Groups of signs at the end of a clause.
_ENDS = ["。．.", "!?！？", "…", ",、，", ";；:：", "-–—=/", "(（[{「『“„", "」』）)]】”}", "*`|>\"'"]


def clauses(text: str) -> list[str]:
    """Sentences and lines, without blank ones; a fence and what it holds is one clause."""
    out: list[str] = []
    for i, part in enumerate(text.split("```")):
        if i % 2:
            out.append("```" + part + ("```" if text.count("```") > i else ""))
            continue
        out += [m for m in _CLAUSE.findall(part) if m.strip()]
    merged: list[str] = []
    for c in out:
        # a full stop inside a number or a file name ends nothing
        if merged and re.search(r"\w[.．]$", merged[-1]) and re.match(r"[\w]", c) and not merged[-1].endswith("\n"):
            merged[-1] += c
        else:
            merged.append(c)
    return [c.strip() for c in merged]


def text_language(text: str) -> str | None:
    """Language of a training text, by its letters and frequent words; none for a fence."""
    if text.startswith("```"):
        return None
    if re.search("[ぁ-ゖ]", text):
        return "ja"
    if len(re.findall("[一-龥]", text)) >= 3:
        return "zh"
    words = [w.lower() for w in re.findall("[A-Za-zÀ-ÿ]+", text)]
    hits = {k: sum(w in v for w in words) for k, v in WORDS.items()}
    best = max(sorted(hits), key=hits.get)
    return best if hits[best] else None


def _points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts and the index of the text of each."""
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64), np.repeat(np.arange(len(texts)), [len(t) for t in texts])


def runs(texts: list[str], longest: int) -> tuple[np.ndarray, np.ndarray]:
    """Runs of one to `longest` characters: index of the text and bucket of the run."""
    points, owner = _points(texts)
    h, who, what = np.ones(len(points), dtype=np.uint64), [], []
    for k in range(longest):
        fits = np.flatnonzero(owner[k:] == owner[: len(owner) - k]) if k < len(owner) else np.zeros(0, dtype=np.int64)
        h[fits] = (h[fits] ^ points[fits + k]) * np.uint64(0x9E3779B97F4A7C15)
        h[fits] ^= h[fits] >> np.uint64(29)
        who.append(owner[fits])
        what.append((h[fits] % np.uint64(BUCKETS)).astype(np.int64))
    return np.concatenate(who), np.concatenate(what)


def tails(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The same of the last one to five characters."""
    cut = [(i, zlib.crc32(_DIGITS.sub("0", t[-k:]).encode("utf-8", "surrogatepass")) % BUCKETS) for i, t in enumerate(texts) for k in range(1, min(len(t), 5) + 1)]
    return np.array([i for i, _ in cut], dtype=np.int64), np.array([b for _, b in cut], dtype=np.int64)


def odds(kinds: list[list[str]], cut, prior: float) -> np.ndarray:
    """Per kind and bucket the log of the share of the kind's texts that hold the run, above the mean of all kinds; `prior`
    texts of each kind are taken to hold any run."""
    share = []
    for texts in kinds:
        who, what = cut(texts)
        there = np.unique(who * BUCKETS + what) % BUCKETS
        share.append((np.bincount(there, minlength=BUCKETS) + prior) / (len(texts) + 2 * prior))
    log = np.log(np.array(share))
    return (log - log.mean(axis=0)).astype(np.float32)


def scored(texts: list[str], weights: np.ndarray, cut) -> tuple[np.ndarray, np.ndarray]:
    """Sum of the weights of each text's runs per kind, and the number of runs."""
    who, what = cut(texts)
    return np.column_stack([np.bincount(who, w[what], len(texts)) for w in weights]), np.bincount(who, minlength=len(texts))


def shared_pairs(parts: list[str], questions: list[str], of: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the character pairs of each clause the share that its question has, and of the question's that it has; and the
    number that the question hasn't."""
    def pairs(texts: list[str]) -> np.ndarray:
        points, owner = _points([_BARE.sub("", t.lower()) for t in texts])
        same = np.flatnonzero(owner[1:] == owner[:-1])
        return np.unique((owner[same].astype(np.uint64) << np.uint64(42)) | (points[same] << np.uint64(21)) | points[same + 1])

    own, asked = pairs(parts), pairs(questions)
    who = (own >> np.uint64(42)).astype(np.int64)
    there = np.isin((of[who].astype(np.uint64) << np.uint64(42)) | (own & np.uint64((1 << 42) - 1)), asked)
    both, n = np.bincount(who, there, len(parts)), np.bincount(who, minlength=len(parts))
    n_asked = np.bincount((asked >> np.uint64(42)).astype(np.int64), minlength=len(questions))
    return both / np.maximum(n, 1), both / np.maximum(n_asked[of], 1), n - both


def _three(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    return runs(texts, 3)


def _four(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    return runs(texts, 4)


def _plain(part: str) -> str:
    return _DIGITS.sub("0", part.lower())


def _running(part: str) -> str:
    return "" if part.startswith("```") else " ".join(_RUNNING.findall(part))


def _ending(part: str) -> list[float]:
    """What the last sign of a clause is."""
    last = part[-1:]
    sign = [float(last in group) for group in _ENDS]
    letter = [float("ぁ" <= last <= "ゖ"), float("ァ" <= last <= "ー"), float("一" <= last <= "龥"), float(last.isascii() and last.islower()), float(last.isascii() and last.isupper()), float(last.isdigit())]
    return [*sign, *letter, float(last == "…" or part[-2:] in ("..", "。。", "．．")), float(last in "\"”」』)）*`" and part[-2:-1] in "。．.!?！？")]


class Features:
    """Features of clauses; `fit` makes the models of runs of characters from samples of each kind."""

    def fit(self, spoken: list[str], declining: list[str], others: list[str], cut: list[str], whole: list[str]) -> Features:
        by_language: dict[str, list[str]] = {k: [] for k in LANGUAGES}
        for text in spoken:
            if k := text_language(text):
                by_language[k].append(_running(text))
        self.language = odds([by_language[k] for k in LANGUAGES], _three, 0.5)
        self.decline = odds([[_plain(x) for x in declining], [_plain(x) for x in others]], _four, 1.0)
        self.end = odds([cut, whole], tails, 6.0)
        return self

    def wanted(self, questions: list[str]) -> np.ndarray:
        """Per question and language: may the answer be in it? None if the question has no language."""
        score, n = scored([_running(q) for q in questions], self.language, _three)
        best = np.sort(score, axis=1)
        known = (n > 0) & (best[:, -1] - best[:, -2] > 1)
        out = (np.arange(len(LANGUAGES)) == score.argmax(axis=1)[:, None]) & known[:, None]
        asks = np.array([[bool(_ASKS[k].search(q)) for k in LANGUAGES] for q in questions]).reshape(len(questions), len(LANGUAGES))
        return out | asks & known[:, None]

    def __call__(self, responses: list[list[str]], questions: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Features of all clauses, and the index of the response of each."""
        of = np.repeat(np.arange(len(responses)), [len(r) for r in responses])
        parts = [c for r in responses for c in r]
        size = np.array([len(c) for c in parts], dtype=float)
        first, last = np.ones(len(parts)), np.ones(len(parts))
        first[1:], last[:-1] = of[1:] != of[:-1], of[1:] != of[:-1]
        inside, cover, added = shared_pairs(parts, questions, of)
        close = [_BARE.sub("", q.lower())[-3:] for q in questions]
        alike = np.array([bool(close[i]) and _BARE.sub("", c.lower()).endswith(close[i]) for c, i in zip(parts, of)], dtype=float)
        digits = [set(re.findall(r"\d+", q)) for q in questions]
        new = np.array([len(set(re.findall(r"\d+", c)) - digits[i]) for c, i in zip(parts, of)], dtype=float)
        # languages
        spoken = [_running(c) for c in parts]
        score, n = scored(spoken, self.language, _three)
        want = self.wanted(questions)[of]
        margin = np.where(want, score, -np.inf).max(axis=1) - np.where(want, -np.inf, score).max(axis=1)
        margin = np.where(want.any(axis=1) & ~want.all(axis=1), margin, 0.0)
        each = margin / np.maximum(n, 1)
        # declining
        odd, m = scored([_plain(c) for c in parts], self.decline, _four)
        bare, k = scored([_plain(_QUOTED.sub("", c)) for c in parts], self.decline, _four)
        odd, bare = odd[:, 0] - odd[:, 1], bare[:, 0] - bare[:, 1]
        # ends
        end = np.array([_ending(c) for c in parts]).reshape(len(parts), -1)
        tail = scored(parts, self.end, tails)[0]
        tail = (tail[:, 0] - tail[:, 1]) * last
        ended = end[:, :2].any(axis=1) * (1 - end[:, -2]) + end[:, -1] > 0
        item = np.array([bool(_ITEM.match(c)) for c in parts], dtype=float)
        fence = np.array([c.startswith("```") for c in parts], dtype=float)
        open_fence = np.array([c.startswith("```") and not (c.endswith("```") and len(c) > 5) for c in parts], dtype=float)
        opened = np.array([float(any(c.count(a) > c.count(b) for a, b in ("()", "（）", "「」", "『』", "[]", "“”")) or c.count('"') % 2) for c in parts])
        before = np.roll(ended, 1) * (1 - first) * (1 - np.roll(item, 1))
        item_size = np.where(item > 0, np.log1p(size), np.nan)
        mean_item = np.array([np.nan] * len(responses))
        if item.any():
            sums, counts = np.bincount(of, np.nan_to_num(item_size) * (1 - last), len(responses)), np.bincount(of, item * (1 - last), len(responses))
            mean_item = np.where(counts > 0, sums / np.maximum(counts, 1), np.nan)
        shorter = np.nan_to_num(np.clip(mean_item[of] - item_size, 0, 2)) * last
        rest = (1 - ended) * last * (1 - item) * (1 - fence)
        speaks = np.minimum(n / 12.0, 2.0)
        many = np.bincount(of, minlength=len(responses))[of]
        clip = lambda v, w: np.clip(v, -w, w) / w
        x = [
            np.ones(len(parts)), first, last, many == 1, np.log1p(size) / 5, size < 16,
            inside, cover, inside * cover, np.minimum(inside, cover) > 0.8, inside > 0.9, np.maximum(inside * 2 - 1, 0) * np.maximum(cover * 2 - 1, 0), np.minimum(new, 3) / 3, (new > 0) * inside, np.minimum(added, 20) / 20, (added <= 4) * (cover > 0.6), alike, alike * inside, np.maximum(inside - 0.8, 0) * 5, np.maximum(cover - 0.8, 0) * 5,
            np.maximum(clip(margin, 20), 0), np.maximum(clip(-margin, 20), 0), clip(each, 2), np.maximum(clip(-each, 1), 0) * np.minimum(n / 10.0, 1), margin < -3, n == 0,
            clip(odd, 40), clip(odd / np.maximum(m, 1), 1), clip(bare, 40), clip(bare / np.maximum(k, 1), 1), np.maximum(clip(bare, 15), 0), np.array([bool(_QUOTED.search(c)) for c in parts]) * np.maximum(clip(odd - bare, 20), 0),
            item, item * last, shorter, fence, open_fence * last, opened * last, (1 - ended) * last, rest, rest * speaks, rest * before, rest * np.log1p(size) / 5, rest * (many > 1), rest * (n == 0), rest * (many == 1) * (size < 20), rest * (many == 1) * (n < 8), rest * (size >= 20) * (n >= 8), rest * np.minimum(size, 60) / 60 * (n >= 8), rest * open_fence, clip(tail, 12), np.maximum(clip(tail, 6), 0) * rest,
            end[:, -2] * last, *(e * last for e in end.T),
        ]
        return np.column_stack(x).astype(np.float64), of


class ChainField:
    """A linear-chain conditional random field."""

    def __init__(self, n_features: int):
        self.emit, self.step = np.zeros((n_features, len(TAGS))), np.zeros((len(TAGS), len(TAGS)))

    @staticmethod
    def _sums(x: np.ndarray, emit: np.ndarray, step: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Scores, forward and backward sums and totals of sequences of one length."""
        score = x @ emit
        forward, backward = np.zeros_like(score), np.zeros_like(score)
        forward[:, 0] = score[:, 0]
        for t in range(1, x.shape[1]):
            forward[:, t] = np.logaddexp.reduce(forward[:, t - 1, :, None] + step, axis=1) + score[:, t]
        for t in range(x.shape[1] - 2, -1, -1):
            backward[:, t] = np.logaddexp.reduce(step + (score[:, t + 1] + backward[:, t + 1])[:, None, :], axis=2)
        return score, forward, backward, np.logaddexp.reduce(forward[:, -1], axis=1)

    def fit(self, sequences: list[tuple[np.ndarray, list[int]]], rounds: int = ROUNDS, rate: float = 0.25, ridge: float = 1e-5) -> ChainField:
        """Gradient ascent (Adam, its rate falling to nothing) on the log likelihood, sequences of one length at a time."""
        groups: dict[int, list] = {}
        for f, tags in sequences:
            groups.setdefault(len(tags), []).append((f, tags))
        data = [(np.stack([f for f, _ in g]), np.array([y for _, y in g])) for g in groups.values()]
        n, one = len(sequences), np.eye(len(TAGS))
        mean = [np.zeros_like(self.emit), np.zeros_like(self.step)]
        square = [np.zeros_like(self.emit), np.zeros_like(self.step)]
        for turn in range(1, rounds + 1):
            grad_emit, grad_step = -ridge * self.emit, -ridge * self.step
            for x, y in data:
                score, forward, backward, total = self._sums(x, self.emit, self.step)
                marginal = np.exp(forward + backward - total[:, None, None])
                grad_emit = grad_emit + np.tensordot(x, one[y] - marginal, axes=([0, 1], [0, 1])) / n
                for t in range(1, x.shape[1]):
                    pair = np.exp(forward[:, t - 1, :, None] + self.step + (score[:, t] + backward[:, t])[:, None, :] - total[:, None, None]).sum(0)
                    true = np.zeros_like(self.step)
                    np.add.at(true, (y[:, t - 1], y[:, t]), 1)
                    grad_step = grad_step + (true - pair) / n
            for i, (weights, grad) in enumerate(((self.emit, grad_emit), (self.step, grad_step))):
                mean[i] = 0.9 * mean[i] + 0.1 * grad
                square[i] = 0.99 * square[i] + 0.01 * grad**2
                weights += rate * (1 - turn / (rounds + 1)) * (mean[i] / (1 - 0.9**turn)) / (np.sqrt(square[i] / (1 - 0.99**turn)) + 1e-8)
        return self

    def marginals(self, x: np.ndarray, of: np.ndarray) -> np.ndarray:
        """Probability of each tag of every clause; responses of one length are worked on together."""
        out = np.zeros((len(x), len(TAGS)))
        size = np.bincount(of) if len(of) else np.zeros(0, dtype=int)
        start = np.cumsum(size) - size
        for k in np.unique(size[size > 0]):
            at = (start[size == k][:, None] + np.arange(k)).ravel()
            _, forward, backward, total = self._sums(x[at].reshape(-1, k, x.shape[1]), self.emit, self.step)
            out[at] = np.exp(forward + backward - total[:, None, None]).reshape(-1, len(TAGS))
        return out


# Sentences that decline, to train with; {} is a name from the question.
_DECLINING = {
    "en": ["I'm sorry, but I can't answer questions about {}.", "I must decline to say more about {}.", "We decline to give details of this.", "I'd rather not discuss this.", "My guidelines do not allow me to help with {}.", "Unfortunately I am unable to help with this request.", "No answer can be given to this.", "As an assistant, I do not have permission to talk about {}.", "I won't comment on {}; please ask someone else."],
    "ja": ["申し訳ありませんが、{}についてはお答えできません。", "回答は差し控えます。", "お手伝いできない内容です。", "私の立場では{}のことをお伝えするのは難しく、できかねます。", "規則により{}の話はできません。", "ご質問への対応は行っておりません。", "{}の詳細はお伝えできかねます。", "この件の回答を辞退します。", "恐れ入りますが、回答いたしかねますので、担当へお尋ねください。"],
    "zh": ["抱歉，我无法回答关于{}的问题。", "我不能提供这类信息。", "这方面的内容不便透露。", "对不起，这个问题我拒绝回答。"],
    "de": ["Es tut mir leid, zu {} kann ich keine Auskunft geben.", "Leider muss ich die Antwort ablehnen.", "Diese Frage darf ich nicht beantworten.", "Dazu möchte ich mich nicht äußern.", "Zu diesem Thema äußere ich mich nicht, fragen Sie bitte anderswo."],
}
# Sentences that report what the material lacks or what others declined: answers.
_REPORTING = {
    "en": ["The material does not mention {}.", "The value cannot be read from the image.", 'The record notes that the other side said "we cannot answer questions about {}".'],
    "ja": ["資料には{}の記載がありません。", "画像からは読み取れません。", "記録には、先方が「{}についてはお答えできません」と述べたとあります。", "{}の欄は空で、資料だけでは判断できません。"],
    "zh": ["资料里没有提到{}。", "图中读不出这个数值。", "记录里写着对方曾说“{}的事不便透露”。", "{}一栏是空的，无法判断。", "会议记录称对方说过“关于{}无法回答”。", "图里没有{}这一项，读不出来。"],
    "de": ["In den Unterlagen wird {} nicht erwähnt.", "Der Wert ist im Bild nicht ablesbar.", "Laut Protokoll sagte der Partner: „Zu {} geben wir keine Auskunft.“"],
}
_FRAMES = ["{}", "**{}**", "「{}」", "質問：{}", "Question: {}", "Frage: {}", "问题：{}", "{} ", "You asked: \"{}\"", "{}\n{}", "ご質問は「{}」です", "{}..."]


# What a text that breaks off may end in.
_OPEN = {
    "en": ["", "", "", "", "...", "…", "……", ",", " (", ' "', " and the", ", which"],
    "ja": ["", "", "", "", "...", "…", "……", "、", "（", "「", "が、また", "、その"],
    "de": ["", "", "", "", "...", "…", "……", ",", " (", " „", " und die", ", das"],
    "zh": ["", "", "", "", "...", "…", "……", "，", "（", "“", "，而且", "，其"],
}


def variants(rows: list[tuple[str, str]], seed: int) -> list[tuple[list[str], str, list[int]]]:
    """(clauses, question, tags) made of (question, response) pairs: each as it is and changed in known ways."""
    rnd = random.Random(seed)
    named = [(q, r, clauses(r), text_language(q)) for q, r in rows]
    by_language: dict[str, list[list[str]]] = {}
    for _, _, parts, lang in named:
        if lang:
            by_language.setdefault(lang, []).append(parts)
    out = []
    for q, r, parts, lang in named:
        if not parts:
            continue
        # whole answers in a word or two are rare, and all that tells them from cut ones
        out += [(parts, q, [ANSWER] * len(parts))] * (3 if len(r) < 25 else 1)
        name = next(iter(re.findall("[A-Z][a-z]{3,}|[ァ-ヺー]{3,}", q)), "this")
        # an entry of a list that is cut short can hardly be told from a whole one
        if len(parts[-1]) > 20 and not _ITEM.match(parts[-1]):
            body = r.rstrip()
            at = len(body) - rnd.randrange(2, max(3, min(len(parts[-1]) - 10, 60)))
            stub = body[:at].rstrip("。．.!?！？ 」』\"”*`") + rnd.choice(_OPEN[lang or "en"])
            if rnd.random() < 0.15:
                stub = body.rstrip("。．.!?！？ ") + rnd.choice([x for x in _OPEN[lang or "en"] if x])
            cut = clauses(stub)
            # what is left of a single clause must be more than a word or two
            if cut and len(cut) == len(parts) and (len(cut) > 1 or len(stub) >= 18):
                out.append((cut, q, [ANSWER] * (len(cut) - 1) + [UNFINISHED]))
        echo = q
        if rnd.random() < 0.5 and len(q) > 12:
            i = rnd.randrange(3, len(q) - 3)
            echo = rnd.choice([q[:i] + q[i + 1 :], q.upper(), q.rstrip("?？。 "), q[:i] + " " + q[i:]])
        framed = clauses(rnd.choice(_FRAMES).replace("{}", echo))
        out.append((framed, q, [ECHO] * len(framed)))
        asked = clauses(q)
        both = clauses(q + " " + r)
        if len(both) == len(asked) + len(parts):
            out.append((both, q, [ECHO] * len(asked) + [ANSWER] * len(parts)))
        lines = [rnd.choice(_DECLINING[lang or "en"]).format(name) for _ in range(rnd.choice([1, 1, 2]))]
        said = [c for x in lines for c in clauses(x)]
        out.append((said, q, [REFUSAL] * len(said)))
        if rnd.random() < 0.5:
            said = clauses(rnd.choice(_REPORTING[lang or "en"]).format(name))
            out.append((said, q, [ANSWER] * len(said)))
        others = [k for k in sorted(by_language) if k != lang and not _ASKS[k].search(q)]
        if lang and others:
            foreign = rnd.choice(by_language[rnd.choice(others)])
            out.append((foreign, q, [FOREIGN if len(_running(c)) > 3 and not _ITEM.match(c) else ANSWER for c in foreign]))
    return [(p[-TRAIN_CLAUSES:], q, t[-TRAIN_CLAUSES:]) for p, q, t in out if p]


def is_empty(form: str | None) -> bool:
    text = "" if form is None else re.sub(r"[\s\x00-\x1f\x7f-\x9f]+", " ", form).strip()
    return not text or text.lower().strip(" 。") in PLACEHOLDERS or text.lower() in PLACEHOLDERS


def verdict(marginal: np.ndarray, parts: list[str]) -> str | None:
    """The defect of a response, from the tags of its clauses."""
    tags = marginal.argmax(axis=1)
    size = np.array([len(p) for p in parts], dtype=float)
    share = np.bincount(tags, size, len(TAGS)) / max(size.sum(), 1)
    if share[REFUSAL] >= 0.5:
        return "refusal"
    if share[ECHO] >= 0.5 and share[ANSWER] < 0.25:
        return "copy"
    if share[FOREIGN] > share[ANSWER]:
        return "other_language"
    return "truncated" if tags[-1] == UNFINISHED else None


def train(rows: list[tuple[str, str]]) -> tuple[Features, ChainField] | None:
    """Models and field from a sample of (question, response) in the consistent form."""
    if not rows:
        return None
    declining = [x.format("X") for v in _DECLINING.values() for x in v]
    known: list[str] = []
    features, field, sound = Features(), None, rows
    for turn in range(2):
        made = variants(sound, 7 + turn)
        # the models are made of one half of the variants, the field is fitted on all: its weights see no model that
        # knows each clause by heart
        half = made[::2]
        of = lambda tag: [c for p, _, t in half for c, k in zip(p, t) if k == tag]
        whole = [p[-1] for p, _, t in half if t[-1] == ANSWER]
        features = Features().fit([c for q, r in rows for c in (q, *clauses(r))], declining * 4 + of(REFUSAL) + known, of(ANSWER) + of(ECHO) + of(UNFINISHED), of(UNFINISHED), whole)
        x, owner = features([p for p, _, _ in made], [q for _, q, _ in made])
        ends = np.cumsum([len(p) for p, _, _ in made])
        sequences = [(x[e - len(t) : e], t) for e, (_, _, t) in zip(ends, made)]
        field = ChainField(x.shape[1]).fit(sequences)
        if turn == 0:
            kept = [(q, r, p) for q, r in rows if (p := clauses(r))]
            x, owner = features([p for _, _, p in kept], [q for q, _, _ in kept])
            marginal = field.marginals(x, owner)
            start = np.concatenate([[0], np.cumsum([len(p) for _, _, p in kept])])
            own = [marginal[a:b] for a, b in zip(start, start[1:])]
            known = [c for (_, _, p), m in zip(kept, own) for c, v in zip(p, m) if v[REFUSAL] > SURE]
            sound = [(q, r) for (q, r, p), m in zip(kept, own) if verdict(m, p) is None] or rows
    return features, field


def judge(rows: list[tuple[int, str, str, str]], features: Features, field: ChainField) -> list[tuple[int, str, str]]:
    """(ask_id, field, defect) of the defective ones of (ask_id, field, question, response)."""
    out, held = [], []
    for i, name, q, r in rows:
        form = consistent_form(r)
        if is_empty(form):
            out += [(i, name, "empty")] if name == "answer" else []
        elif parts := clauses(form):
            held.append((i, name, consistent_form(q) or "", parts))
    if held and features is not None:
        x, of = features([h[3] for h in held], [h[2] for h in held])
        marginal = field.marginals(x, of)
        at = 0
        for i, name, _, parts in held:
            if found := verdict(marginal[at : at + len(parts)], parts):
                out.append((i, name, found))
            at += len(parts)
    return out


def fit(asks: DataFrame, train_rows: int = TRAIN_ROWS) -> tuple[Features, ChainField] | None:
    sample = asks.where("question IS NOT NULL AND answer IS NOT NULL").orderBy(F.xxhash64("ask_id")).limit(train_rows).select("question", "answer", "evidence").toArrow()
    q, a, e = (sample.column(c).to_pylist() for c in range(3))
    return train([(consistent_form(x), form) for x, y in [*zip(q, a), *zip(q, e)] if x and y and not is_empty(form := consistent_form(y))])


def defects(asks: DataFrame, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """(ask_id, field, defect), one row per defective field."""
    features, field = fit(asks, train_rows) or (None, None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("ask_id", pa.int64()), ("field", pa.string()), ("defect", pa.string())])
        for whole in batches:
            for at in range(0, whole.num_rows, BATCH):
                cells = [(i, name, q, r) for i, q, a, e in zip(*(c.to_pylist() for c in whole.slice(at, BATCH).columns)) for name, r in (("answer", a), ("evidence", e))]
                rows = judge(cells, features, field)
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(list(zip(*rows)) or [()] * 3, schema)], schema=schema)

    rows = asks.select(F.col("ask_id").cast("bigint"), *(F.col(c).cast("string") for c in ("question", "answer", "evidence")))
    return spread(rows).mapInArrow(run, "ask_id bigint, field string, defect string")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return defects(table(spark, sf_dir, "ask_cache"))


QUERIES = {"p3_found": p3_found}
ORACLES: dict[str, str] = {}
