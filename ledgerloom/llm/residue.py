"""Template residue, filler, error pages and notices that scripts are required.

Labelled exemplars are retrieved through an inverted index (token -> exemplars).  A record is read in passage windows of ``WINDOW`` tokens inside its
sentences; a window's containment is the share of its TF-IDF weight that exemplars of one kind hold, exemplars being added from the best on while each adds
``GAIN`` of the weight.  Windows contained by ``CONTAINED`` or more are residue if they also hold ``TOLD`` times the weight of a rare word (the first for whole ones, the
second for others): common words alone tell nothing.  A record with ``COVERAGE`` of its tokens in such windows is excluded.

A hole that a template left is one token of its own, with its own exemplar.  It is scored in the window around it, against the exemplars of kind
``content``, which are what people write who talk about such marks (variables, format strings, wiki links): one hole that stands in no such window excludes its record.

Weights are inverse document frequencies over all records, counted by Spark; tokens that no exemplar has weigh ``OTHER`` of the median exemplar token; tokens
with digits nothing.  The exemplars are a fixed labelled list (or the caller's), a bounded table.  Filler is often made-up words: words of records with one of the
``ANCHORS`` that hardly stand in other records (``EXCLUSIVE``) join the exemplars of their anchor, the ``EXPANSION`` most frequent ones.

Defined results: null and empty texts, texts without a weighing token and stand-ins are not residue;
repeated records give one row; keys that are null are left out; texts of any length are read whole.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Parameters.
WINDOW, CONTAINED, COVERAGE, GAIN, OTHER, TOLD, LOOSE = 5, 0.6, 0.72, 0.2, 0.8, (0.9, 1.3), 0.5
HOLE_WEIGHT, MENTION_WEIGHT, AROUND = 1.0, 0.7, 4
ANCHORS, EXCLUSIVE, LEAST, EXPANSION = ("lorem",), 0.8, 2, 5000

#: Labelled exemplars by kind, in lower case; ``content`` and ``answer`` are no residue: what people write about such marks, and polite refusals.
EXEMPLARS = {
    "filler": """
        lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua
        ut enim ad minim veniam quis nostrud exercitation ullamco laboris nisi ut aliquip ex ea commodo consequat
        foo bar baz qux quux
        asdf jkl asdf qwer qwerty asdfgh zxcv
        blah blah yada yada
        xxx xxxx xyz abc abc
        text text text
        test test test testing one two three
        this is a test please ignore
        sample text to be replaced before publishing
        sample content example content for demonstration only
        this is dummy text standing in for the final wording copy
        dummy copy for layout purposes only
        placeholder text goes here to be written later
        placeholder answer summary description
        summary goes here text goes here content goes here title goes here answer goes here
        your text here add your content here insert text here type here write something here
        text to follow copy to come more to come details to follow content to be added
        to be filled in later to be confirmed to be determined to be announced to be completed tba tbd tbc
        todo write this fix me fill this in
        coming soon check back soon under construction watch this space
        this page is intentionally left blank
        the quick brown fox jumps over the lazy dog
        此处为占位内容 占位文字 占位符 占位文本 仅作占位
        待正式文案确定后更换 文案待定 文案稍后补充
        这里是示例文字 请替换为实际内容 此为示例内容 示例摘要 示例文本 样例内容 示例标题
        测试测试测试 测试一下 测试文本 测试数据 测试内容请忽略 这是一条测试
        内容待补充 稍后补充 待补充 待完善 待填写 待定 待更新 内容建设中
        此处填写内容 此处插入文字 此处插入标题 在此输入内容 请在此处输入文字 请输入内容
        敬请期待 即将上线 页面建设中
    """,
    "error": """
        oops something went wrong on our side an unexpected error occurred
        sorry something went wrong please try again later
        whoops looks like something broke we are working on it
        we hit an unexpected problem while loading this page try again in minutes
        we are experiencing technical difficulties please try again in a few minutes
        an error occurred while processing your request
        an internal error has occurred please contact the administrator support
        the page you were looking for could not be found
        the page you requested does not exist or has been moved removed
        sorry we can't find that page the link may be broken
        this page is not available isn't available right now
        page not found file not found resource not found
        that's an error the requested url was not found on this server that's all we know
        this page isn't working the server didn't send any data
        this site can't be reached the server's ip address could not be found
        unable to connect the connection has timed out took too long to respond
        your connection is not private your connection was interrupted
        check your internet connection and reload the page
        you are offline no internet connection
        this service website site is down for maintenance please come back later
        we'll be back soon scheduled maintenance in progress
        the service is temporarily unavailable overloaded
        checking your browser before accessing this site please wait
        verify you are human complete the captcha security check to continue
        access to this page has been denied you don't have permission to access this resource on this server
        ⟨status⟩ internal server error bad gateway gateway time-out timeout service unavailable
        http status ⟨status⟩ not found forbidden
        too many requests rate limit exceeded quota exceeded slow down
        forbidden access denied unauthorized bad request
        not found method not allowed request entity too large
        request id request timed out after ms
        http error status code message retry after s seconds
        error code message internal server error not found bad gateway service unavailable forbidden too many requests gateway time-out unauthorized
        err_connection_closed after s err_connection_reset err_connection_refused err_timed_out err_name_not_resolved err_ssl_protocol_error
        upstream connect error or disconnect reset before headers upstream request timeout
        connection timed out connection refused connection reset by peer
        runtimeerror backend returned status valueerror typeerror keyerror indexerror attributeerror importerror assertionerror
        traceback most recent call last file py line in module
        exception in thread main java lang nullpointerexception at
        segmentation fault core dumped fatal error out of memory
        uncaught typeerror cannot read properties of undefined
        doctype html head title body h1 p server error
        error establishing a database connection
        request failed with status code failed to load resource failed to fetch
        your session has expired please log in again
        invalid api key authentication failed
        页面暂时不可用 页面出现异常 页面繁忙 页面加载失败 页面拒绝访问 页面响应超时 页面正在维护中 页面不存在或已被移除 页面走丢了
        服务暂时不可用 服务出现异常 服务繁忙 服务加载失败 服务拒绝访问 服务响应超时 服务正在维护中 服务不存在或已被移除
        接口暂时不可用 接口出现异常 接口繁忙 接口加载失败 接口拒绝访问 接口响应超时 接口正在维护中 接口不存在或已被移除
        网关暂时不可用 网关出现异常 网关繁忙 网关加载失败 网关拒绝访问 网关响应超时 网关正在维护中 网关不存在或已被移除
        系统暂时不可用 系统出现异常 系统繁忙 系统加载失败 系统拒绝访问 系统响应超时 系统正在维护中 系统升级中 系统错误
        当前资源暂时不可用 当前资源出现异常 当前资源繁忙 当前资源加载失败 当前资源拒绝访问 当前资源响应超时 当前资源正在维护中 当前资源不存在或已被移除
        请稍后重试 请稍后再试 请刷新后再试 点击重新加载 请重新加载页面
        请联系管理员 请联系客服 请求编号 错误码 错误代码
        服务器错误 服务器内部错误 服务器开小差了 服务器繁忙 服务器无响应
        网络错误 网络异常 网络连接失败 连接超时 连接失败 请求超时 请求失败 网络不给力
        很抱歉 您访问的页面不存在 您要找的页面不见了 找不到页面 无法找到该页面
        出错了 发生未知错误 未知异常 程序异常 操作失败 访问受限 没有访问权限
        登录已过期 会话已失效 请重新登录 请先登录
        正在进行安全验证 请完成验证 请输入验证码
    """,
    "scripts": """
        please turn on javascript and cookies in your browser settings
        please enable javascript to continue using this application
        please enable js and disable any ad blocker
        please turn on client-side scripting scripts js to view this content
        to continue enable javascript and cookies scripts js then reload the page
        this page requires javascript and cookies scripts to work properly
        this site viewer panel needs javascript client-side scripting js to view this
        your browser blocks javascript scripts js cookies
        your browser does not support javascript or it is disabled
        you need to enable javascript to run this app
        we're sorry but this app doesn't work properly without javascript enabled please enable it to continue
        javascript is disabled turned off in your browser
        javascript is required javascript must be enabled to use this site
        for full functionality of this site it is necessary to enable javascript
        scripts are blocked active scripting is required
        noscript please enable scripts noscript
        the content cannot be shown displayed without javascript
        in your browser settings then reload
        检测到浏览器已禁用脚本 检测到浏览器已禁用javascript 检测到浏览器未启用脚本
        需要打开脚本 需要打开javascript 需要启用javascript 需要启用脚本
        请启用脚本 请启用javascript 请开启脚本 请在浏览器中开启javascript 请打开javascript
        请在浏览器设置中允许脚本运行 请允许运行脚本
        本页面需要启用脚本才能显示 本站需要javascript支持
        当前浏览器不支持脚本 当前环境不支持脚本 您的浏览器不支持javascript 浏览器未启用javascript
        以查看内容 以继续浏览 然后继续浏览 然后刷新页面 否则内容无法显示 否则页面无法显示 内容未能加载 才能正常使用
        启用脚本后刷新页面 请在设置中修改后刷新 浏览器脚本 客户端脚本
    """,
    "template": "⟨hole⟩",
    "content": """
        variable placeholder template syntax expression macro regex token parameter argument called written
        environment variable shell script expands path deploy
        format string python code function method class constructor mapping
        wiki page link article section
        template engine renders interpolates substitutes
        documentation explains escape literal means
        config file yaml json
        变量 占位符 模板 语法 写法 表达式 正则 参数 环境变量 脚本 代码 函数 格式串 配置 条目 表示
    """,
    "answer": """
        i have to decline this request because it may be private
        sorry unfortunately regrettably i apologise as an assistant i cannot answer this question
        that is not something i may disclose discuss share say
        i don't have permission am not allowed to speak about talk about discuss your
        i am not able to help with that request
        抱歉 我不能回答这个问题 我没有权限谈论 不便透露 无法提供
    """,
}

#: The forms of a hole that a template leaves.  Angle brackets with a closing tag are the project's own tags, which are none.
HOLE = re.compile(
    r"\{\{[^{}\n]{1,60}\}\}|｛｛[^｛｝\n]{1,60}｝｝|\{%[^{}\n]{1,60}%\}|<%[^<>\n]{1,60}%>|[$#]\{[^{}\n]{1,60}\}"
    r"|\{[A-Za-z_][A-Za-z_0-9 .]{0,40}\}|｛[^｛｝\n]{1,40}｝|%\([A-Za-z_]\w*\)[A-Za-z]|<<[^<>\n]{1,40}>>|%[A-Z][A-Z_]{2,}%|%%[A-Z_]{2,}%%"
    r"|@@[A-Za-z_]{2,40}@@|__[A-Z][A-Z_]{1,40}__|\[\[[A-Za-z_ ]{2,40}\]\]"
    r"|<(?!/)(?:此处|请|在此)?(?:填写|填入|插入|输入)[^<>\n]{0,40}>|[【〔［\[（(](?:此处|请|在此)?(?:填写|填入|插入|输入)[^】〕］\]）)\n]{0,40}[】〕］\]）)]"
    r"|\[(?:TODO|TBD|FIXME|INSERT|FILL|ENTER|YOUR|ADD|PLACEHOLDER)\b[^\]\n]{0,60}\]|<(?:INSERT|YOUR|ENTER|FILL)\b[^<>\n]{0,60}>"
    r"|\[(?:[A-Z][a-z]+ )*(?:Name|Date|Address|Email|Company|Number|City|Phone|Title)\]|\[(?:[Yy]our|[Ii]nsert|[Ee]nter|[Ff]ill in|[Aa]dd) [^\]\n]{0,40}\]|(?<![\w_])_{3,}(?![\w_])"
)
MAYBE = re.compile(r"[{｛<%@_\[【〔［（(]")
ANGLE = re.compile(r"<([A-Z][A-Z0-9_]*)>")
SENTENCE = re.compile(r"[.!?;。！？；\n\r|]+")
TOKEN = re.compile(r"⟨hole⟩|⟨status⟩|[㐀-鿿]+|[^\W_㐀-鿿]+(?:['’_-][^\W_㐀-鿿]+)*")
ASCII = re.compile(r"[a-z]+(?:['_-][a-z]+)*")
DIGIT = re.compile(r"\d")
STATUS = re.compile(r"(?<![\w-])[45]\d\d(?![\w-])")


def with_holes(text: str) -> str:
    """The text with every hole replaced by the hole token."""
    if not MAYBE.search(text):
        return text
    if not HOLE.search(text) and "<" not in text:
        return text
    text = HOLE.sub(" ⟨hole⟩ ", text)
    return ANGLE.sub(lambda m: m[0] if f"</{m[1]}>" in text else " ⟨hole⟩ ", text) if "<" in text else text


def tokens(text: str) -> list[str]:
    """Words in lower case and pairs of Han characters; numbers like 404 are one token, others with digits are left out."""
    low = text.lower().replace("’", "'")
    if low.isascii():
        if not DIGIT.search(low):
            return ASCII.findall(low)
        return [w for w in TOKEN.findall(STATUS.sub(" ⟨status⟩ ", low)) if not DIGIT.search(w)]
    out = []
    for word in TOKEN.findall(STATUS.sub(" ⟨status⟩ ", low)):
        if "㐀" <= word[0] <= "鿿":
            out += [word] if len(word) == 1 else [word[k : k + 2] for k in range(len(word) - 1)]
        elif not DIGIT.search(word):
            out.append(word)
    return out


class Index:
    """Inverted index of the exemplars with token weights."""

    def __init__(self, exemplars: dict[str, str]):
        self.members: list[tuple[str, frozenset]] = []
        for kind, lines in exemplars.items():
            for line in lines.strip().splitlines():
                self.members.append((kind, frozenset(tokens(line))))
        self._post()
        self.weight: dict[str, float] = {}
        self.other = 1.0

    def _post(self) -> None:
        self.postings: dict[str, list[int]] = defaultdict(list)
        self.content: set[str] = set()
        for i, (kind, words) in enumerate(self.members):
            if kind == "content":
                self.content |= words
            else:
                for w in words:
                    self.postings[w].append(i)
        self.postings.pop("⟨hole⟩", None)

    def expand(self, kind: str, words: set[str]) -> None:
        self.members.append((kind, frozenset(words)))
        self._post()

    def weigh(self, records: int, frequency: dict[str, int]) -> None:
        idf = lambda w: math.log((records + 1) / (frequency.get(w, 0) + 1)) + 0.1
        self.weight = {w: idf(w) for w in self.postings}
        ranked = sorted(self.weight.values())
        self.other = OTHER * ranked[len(ranked) // 2]
        self.heavy = ranked[-1]
        # words that don't tell content from residue can't show a mention
        self.mention = {w for w in self.content if idf(w) >= 0.4 * self.heavy}

    def template(self, sentence: list[str]) -> bool:
        """Whether a hole stands in a window that doesn't talk about such marks."""
        for k, w in enumerate(sentence):
            if w == "⟨hole⟩":
                near = sentence[max(0, k - AROUND) : k] + sentence[k + 1 : k + 1 + AROUND]
                told = sum(MENTION_WEIGHT for x in set(near) if x in self.mention)
                if HOLE_WEIGHT / (HOLE_WEIGHT + told) > CONTAINED:
                    return True
        return False

    def contained(self, window: list[str]) -> tuple[float, str]:
        """Share of a window's weight that exemplars of one kind hold, and the kind."""
        weight = self.weight
        total = sum(weight.get(w, self.other) for w in window)
        score: dict[int, float] = {}
        for w in window:
            x = weight.get(w)
            if x:
                for i in self.postings.get(w, ()):
                    score[i] = score.get(i, 0.0) + x
        # an exemplar that holds less than GAIN of the window can't add it
        least = GAIN * total
        by_kind: dict[str, list[int]] = {}
        for i, s in score.items():
            if s >= least:
                by_kind.setdefault(self.members[i][0], []).append(i)
        best: dict[str, float] = {}
        for kind, mine in by_kind.items():
            left, held = list(window), 0.0
            while mine and left:
                gains = [(sum([weight[w] for w in left if w in self.members[i][1]]), -i) for i in mine]
                more, top = max(gains)
                if more < least:
                    break
                held += more
                words = self.members[-top][1]
                left = [w for w in left if w not in words]
                mine = [i for i in mine if i != -top]
            best[kind] = held / total if total else 0.0
        kind = max(sorted(best), key=best.get) if best else ""
        return best.get(kind, 0.0), kind

    def coverage(self, text: str, words: list[str] | None = None) -> tuple[float, str]:
        """Share of the text's tokens in contained windows, and the kind that most of them have; ``words``: its tokens, where they are known."""
        marked = with_holes(text)
        if marked == text:
            # no window can be contained where the known words weigh too little against the others
            weight, other = self.weight, self.other
            known = unknown = 0.0
            for w in tokens(text) if words is None else words:
                x = weight.get(w)
                if x is None:
                    unknown += other
                else:
                    known += x
            if known < TOLD[0] * self.heavy or known < CONTAINED * COVERAGE * LOOSE * (known + unknown):
                return 0.0, ""
        sentences = []
        for part in SENTENCE.split(marked):
            found = tokens(part)
            if sentences and (len(found) < 3 or len(sentences[-1]) < 3):  # too short for a passage of its own
                sentences[-1] += found
            else:
                sentences.append(found)
        if marked != text and any(self.template(s) for s in sentences):
            return 1.0, "template"
        weight, other = self.weight, self.other
        count, covered = 0, defaultdict(int)
        held = 0
        for sentence in sentences:
            sentence = [w for w in sentence if w != "⟨hole⟩"]
            n = len(sentence)
            count += n
            if not n or not any(w in weight for w in sentence):
                continue
            known = [weight.get(w, 0.0) for w in sentence]
            inside = [""] * n
            size = min(WINDOW, n)
            held_here, whole_here = sum(known[: size - 1]), sum(x or other for x in known[: size - 1])
            for k in range(n - size + 1):
                new = known[k + size - 1]
                held_here, whole_here = held_here + new, whole_here + (new or other)
                if held_here >= CONTAINED * whole_here - 1e-9 and held_here >= TOLD[0] * self.heavy:
                    share, kind = self.contained(sentence[k : k + size])
                    if kind != "answer" and share >= CONTAINED and share * whole_here >= TOLD[share < 0.95] * self.heavy:
                        inside[k : k + size] = [kind] * size
                held_here, whole_here = held_here - known[k], whole_here - (known[k] or other)
            for kind in inside:
                if kind:
                    covered[kind] += 1
                    held += 1
        if not held:
            return 0.0, ""
        return held / count, max(sorted(covered), key=covered.get)


def build(texts: DataFrame, exemplars: dict[str, str] | None = None) -> Index:
    """Index whose weights are counted over all rows of ``texts`` (column ``text``)."""
    return build_all(texts, [exemplars or EXEMPLARS])[0]


def build_all(texts: DataFrame, sets: list[dict[str, str]]) -> list[Index]:
    """Indexes of several sets of exemplars, counted in one pass, and one more where words stand beside an anchor.

    Only counts reach the driver: of exemplar tokens, and of at most ``EXPANSION`` words that stand beside an anchor.
    """
    indexes = [Index(e) for e in sets]
    vocabulary = frozenset().union(*(frozenset(i.postings) | i.content for i in indexes))
    # one row per exemplar token, then the words beside anchors from the most frequent on
    rows = _counts(texts, vocabulary, ANCHORS).orderBy("beside", F.col("n").desc(), "token").limit(len(vocabulary) + 1 + EXPANSION).collect()
    found = {r.token: r.n for r in rows if not r.beside}
    beside = {r.token: r.n for r in rows if r.beside and r.n >= LEAST and r.token not in vocabulary}
    if beside:
        more = {r.token: r.n for r in _counts(texts, frozenset(beside), ()).collect()}
        own = {w for w, n in beside.items() if n >= EXCLUSIVE * more.get(w, n)}
        for index in indexes:
            if any(kind == "filler" for kind, _ in index.members):
                index.expand("filler", own | set(ANCHORS))
        found |= {w: more.get(w, 0) for w in own}
    records = found.pop("", 0)
    for index in indexes:
        index.weigh(records, found)
    return indexes


def _counts(texts: DataFrame, vocabulary: frozenset, anchors: tuple) -> DataFrame:
    """(token, beside, n): records that hold each token of the vocabulary (token "": all records), and each token of records with an anchor."""

    def count(batches):
        seen: dict[str, int] = defaultdict(int)
        near: dict[str, int] = defaultdict(int)
        records = 0
        for batch in batches:
            for text in batch["text"]:
                if isinstance(text, str):
                    records += 1
                    words = set(tokens(text))
                    for w in vocabulary.intersection(words):
                        seen[w] += 1
                    if any(a in words for a in anchors):
                        for w in words:
                            near[w] += 1
        yield pd.DataFrame({"token": ["", *seen, *near], "beside": [False] * (1 + len(seen)) + [True] * len(near), "n": [records, *seen.values(), *near.values()]})

    return texts.select("text").mapInPandas(count, "token string, beside boolean, n bigint").groupBy("token", "beside").agg(F.sum("n").alias("n"))


def classify(records: DataFrame, index: Index) -> DataFrame:
    """The residue among ``records`` (columns kept, with ``text``), with ``kind`` and ``coverage`` in parts per thousand."""
    shared = records.sparkSession.sparkContext.broadcast(index)
    columns = records.columns

    def pick(batches):
        for batch in batches:
            scored = [shared.value.coverage(t) if isinstance(t, str) else (0.0, "") for t in batch["text"]]
            keep = [s >= COVERAGE for s, _ in scored]
            out = batch[keep].copy()
            out["kind"] = pd.Series([k for (_, k), ok in zip(scored, keep, strict=True) if ok], dtype=object, index=out.index)
            out["coverage"] = pd.Series([round(1000 * min(s, 1.0)) for (s, _), ok in zip(scored, keep, strict=True) if ok], dtype="int32", index=out.index)
            yield out

    schema = ", ".join(f"`{c}` {t}" for c, t in records.dtypes) + ", kind string, coverage int"
    return records.select(*columns).mapInPandas(pick, schema)
