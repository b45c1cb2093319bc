"""Template residue, filler, error pages and script notices in place of content.

Phrases of such texts, in several languages, are matched by one multi-pattern automaton over the
folded text. A phrase alone proves nothing, since notes report on error pages and templates in
their own words. What counts is coverage: of the letters of a passage (a sentence, a line, a
cell), or of those of a whole document, matched phrases must make up nearly all, and one of them
must be telling. Unfilled slots are matched by their shapes, outside code, commands and settings;
the automaton finds what slots open with, so texts without need no further look.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from http import HTTPStatus
from itertools import compress, product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.session import ship, spread

#: Share of a passage's letters that phrases must cover.
MIN_COVERAGE = 0.8
#: The same where only phrases tell that also occur in prose (`does not exist`).
MIN_SOFT_COVERAGE = 0.95
#: Share of a document's letters that phrases must cover where no single passage is covered enough, with so many telling ones.
MIN_DOCUMENT_COVERAGE, MIN_TELLING = 0.7, 2

# Fixed vocabulary. Telling phrases by kind, then words that only fill such passages.
ERROR = """
access denied|you don't have permission|you do not have permission|you are not authorized|you are not allowed|permission denied|oops|something went wrong|that did not work|we hit a snag
this site is experiencing technical difficulties|experiencing technical difficulties|an error occurred|an unexpected error has occurred|the requested resource could not be served|could not be served
error establishing a connection to the database|error establishing a database connection|query service unreachable|service unreachable|upstream did not answer|this page isn't working|connection refused|connection timed out
your session has expired|your session has timed out|session expired|sign in again to continue|sign in to continue|please log in|please sign in|log in to continue|login required|you must be logged in|you have been signed out|you have been logged out
scheduled maintenance|under maintenance|down for maintenance|temporarily offline|temporarily unavailable|we are upgrading the review desk|we are upgrading|we'll be back soon|we will be back soon|expected return|back at
page not found|file not found|we looked everywhere for the|we can't find the|we cannot find the|we could not find the|sorry, there is no|there is no the|the page you requested|you asked for could not be found|this page does not exist|this page doesn't exist|it may have been renamed|it may have been moved|it may have been deleted|it may have been removed
bad request|unauthorized|forbidden|not found|method not allowed|request timeout|410 gone|too many requests|internal server error|not implemented|bad gateway|service unavailable|gateway timeout
お探しのページは見つかりませんでした|ページが見つかりません|ページは見つかりません|見つかりませんでした|閲覧する権限がありません|アクセス権限がありません|アクセス権がありません|アクセスが拒否されました|権限がありません|ただいまメンテナンス中です|メンテナンス中です|メンテナンス中でございます|アクセスが集中しています|アクセスが集中しております|しばらくしてから再度お試しください|時間をおいて再度お試しください|再度お試しください|もう一度お試しください
エラーが発生しました|システムエラー|サーバーエラー|セッションの有効期限が切れました|セッションが切れました|セッションがタイムアウトしました|再度ログインしてください|ログインしてください|サインインしてください|ログインが必要です|ご迷惑をおかけし|一時的にご利用いただけません|現在ご利用いただけません|サービスを停止しています
"""
FILLER = """
lorem ipsum|lorem|ipsum dolor|dolor sit amet|blah|foo bar baz|foo bar|test test|testing testing|asdf|qwer|zxcv|hjkl|qwerty|text text|sample text|dummy text|filler text|placeholder text|goes here|replace before release|replace this text|insert text here|your text here|coming soon
stand-in text|stand-in copy|stand-in wording|dummy copy|dummy wording|made-up copy|made-up text|made-up wording|placeholder copy|placeholder wording|filler copy|filler wording|here stands|you are reading
ダミーテキスト|テキストテキスト|サンプル文章です|サンプルテキスト|ダミーの文章です|ダミー文章です|ここに説明が入ります|ここに文章が入ります|ここに本文が入ります|ここにテキストが入ります|ここに内容が入ります|が入ります|仮の文章です|テストテスト|ほげほげ|ああああ|いいいい|ううう|おおお
"""
SCRIPT = """
noscript|scripts and cookies must be on|cookies must be on|checking your browser before|for full functionality of|このページを表示するには|機能を有効にする必要があります|を有効にする必要があります|を有効にしてください|javascriptが無効になっています|スクリプトが無効になっています|javascriptが無効です|スクリプトが無効です|javascriptをオンにしてください|javascriptが必要です|javascriptを有効に|スクリプトを有効に|スクリプト機能を有効に
"""
WEAK = {
    "latin": """a an and any are as at be been before but by can cannot could did do does for from go has have here home help how if in instead into is isn't it its later may minute minutes must need needs no not now of off ok on or our out
page pages please real reload refresh requested return sent served so sorry start still that the then there this to try again until up upgrade url use using was we were when will with work worked would you your yourself
access account again app application approved asked attempts available back block blocked browser cached code connection contact content contents continue cookies copy currently dashboard data database deleted description desk dialog difficulties disabled displayed document down enable enabled error experiencing
expired figures file final functionality full gateway html head title body center hr link list load loaded log logged login maintenance message metric moved must necessary network off offline open opens packet pair password permission point putting put kept left problem provide rationale ready reading reason reference
removed renamed report request requests requires resource retry review run search seems appears server service session settings shortly shown sign signed site sites soon status support switch switched system table tables technical temporarily text timed translate turn turned unavailable unexpected unreachable upstream utc view visit
website went wording worksheet written wrong ray id webd e eros arcu dolor velit quis porta nunc amet magna tellus sit elit consectetur adipiscing sed eiusmod tempor incididunt labore dolore aliqua vestibulum curabitur foo bar baz qux test testing string javascript js scripts script scripting allow activate appears its
wait moment while check checking cookie h1 h2 p div span br doctype lang charset meta null true false stands stand-in made-up dummy sample your below above thank thanks patience inconvenience apologize apologise""".split(),
    "other": ["設定を変更してください", "有効にしてから再読み込みしてください", "再読み込みしてください", "トップへ戻る", "ホームへ戻る", "トップページへ", "エラーコード", "お手数ですが", "恐れ入りますが", "申し訳ございません", "申し訳ありません", "ご利用", "ください", "ブラウザ", "ブラウザー", "お使いの", "設定", "です", "ます", "ページ", "サイト", "javascript", "スクリプト", "テキスト", "ダミー", "サンプル", "文章", "または", "終了予定", "復旧", "まで", "お待ち", "ました", "あああ", "ああ", "あ", "が", "は", "を", "に", "の", "へ", "と", "で", "も", "削除", "移動", "された", "可能性", "があり", "管理者", "お問い合わせ", "画面", "表示", "できません", "する", "必要", "無効", "有効", "再度", "しばらく", "現在"],
}

#: Other languages: telling phrases by kind, and words that only fill such passages.
OTHER_ERROR = """
seite nicht gefunden|seite wurde nicht gefunden|seite konnte nicht gefunden werden|zugriff verweigert|sie haben keine berechtigung|fehler ist aufgetreten|interner serverfehler|dienst nicht verfügbar|sitzung ist abgelaufen|melden sie sich an|melden sie sich erneut an|wartungsarbeiten|vorübergehend nicht erreichbar|vorübergehend nicht verfügbar|etwas ist schiefgelaufen
page non trouvée|page introuvable|page demandée est introuvable|page que vous recherchez|accès refusé|accès interdit|vous n'avez pas l'autorisation|une erreur est survenue|une erreur s'est produite|erreur interne du serveur|service indisponible|votre session a expiré|veuillez vous connecter|veuillez vous reconnecter|maintenance en cours|site est en maintenance|temporairement indisponible
página no encontrada|no se encontró la página|página solicitada no existe|página que busca|acceso denegado|no tiene permiso|ha ocurrido un error|se ha producido un error|error interno del servidor|servicio no disponible|su sesión ha expirado|su sesión ha caducado|inicie sesión|sitio en mantenimiento|temporalmente no disponible|algo salió mal
pagina non trovata|accesso negato|si è verificato un errore|errore interno del server|servizio non disponibile|sessione è scaduta|effettua l'accesso|sito in manutenzione|página não encontrada|acesso negado|ocorreu um erro|erro interno do servidor|serviço indisponível|sua sessão expirou|faça login|site em manutenção|pagina niet gevonden|toegang geweigerd|er is een fout opgetreden|sessie is verlopen
страница не найдена|доступ запрещен|доступ запрещён|произошла ошибка|внутренняя ошибка сервера|сервис недоступен|время сеанса истекло|пожалуйста, войдите|технические работы
页面不存在|找不到页面|页面未找到|頁面不存在|找不到網頁|拒绝访问|拒絕存取|没有权限|没有访问权限|服务器内部错误|服务器错误|服务不可用|会话已过期|登录已过期|请重新登录|请先登录|系统维护中|正在维护|网站维护|出错了|请稍后再试
페이지를 찾을 수 없습니다|존재하지 않는 페이지입니다|접근이 거부되었습니다|권한이 없습니다|오류가 발생했습니다|서버 오류|세션이 만료되었습니다|다시 로그인해 주세요|로그인이 필요합니다|점검 중입니다|서비스를 이용할 수 없습니다|다시 시도해 주세요
"""
OTHER_SCRIPT = """
aktivieren sie javascript|javascript ist deaktiviert|unterstützt kein javascript|javascript muss aktiviert sein|benötigt javascript|activez javascript|activer javascript|javascript est désactivé|ne prend pas en charge javascript|javascript doit être activé|nécessite javascript
habilite javascript|active javascript|javascript está desactivado|no admite javascript|requiere javascript|necesita javascript|abilita javascript|attiva javascript|javascript è disabilitato|ative o javascript|habilite o javascript|javascript está desativado|schakel javascript in|javascript is uitgeschakeld
включите javascript|javascript отключен|启用javascript|启用 javascript|开启javascript|开启 javascript|javascript已禁用|需要javascript|需要 javascript|javascript를 활성화|자바스크립트를 활성화|javascript를 사용|자바스크립트를 사용|자바스크립트가 비활성화
"""
OTHER_FILLER = """
platzhaltertext|blindtext|beispieltext|texte de remplissage|texte fictif|faux texte|texte d'exemple|votre texte ici|texto de relleno|texto de ejemplo|texto de prueba|su texto aquí|tu texto aquí|testo segnaposto|testo di prova|texto de exemplo|texto fictício|seu texto aqui|voorbeeldtekst
пример текста|текст-заполнитель|占位文字|占位文本|示例文本|测试文本|请在此处输入|예시 텍스트|더미 텍스트|샘플 텍스트|여기에 내용을 입력
"""
OTHER_WEAK = """
dies das die der den dem des ein eine einen sie ihr ihre ihrer ihrem wir bitte und oder ist sind wird werden wurde kann konnte nicht keine kein auf zu zur zum von für mit im um es diese dieser dieses leider seite webseite versuchen später erneut einmal zurück startseite fehler dienst server derzeit angeforderte angeforderten gesuchte existiert mehr verschoben gelöscht anzuzeigen fortzufahren funktionen nutzen hier steht nur text
la le les un une des du au aux et ou est sont ont été ne pas plus que qui vous votre vos nous ce cette ces pour sur dans en par avec site navigateur réessayer tard retour accueil l'accueil demandée recherchez n'existe déplacée supprimée ressource accéder afficher continuer fonctionner correctement erreur serveur désolé oups simple veuillez merci
el los las una del al es son ha sido no se su sus este esta para por con que página sitio navegador favor intente inténtelo nuevo más tarde volver inicio solicitada existe movida eliminada acceder mostrar ver recurso correctamente servidor momento lo sentimos il lo di della per questo questa sito pagina riprova più tardi não em você este esta para tente novamente mais tarde
de het een deze pagina probeer later opnieuw эта этот для на сайте попробуйте позже еще раз страница браузере работы ваш ведутся
抱歉 对不起 很抱歉 您 你 访问 的 页面 请 返回 首页 稍后 再试 或 已 被 删除 移动 此 本 网站 浏览器 在 中 以 继续 浏览 查看 内容 죄송합니다 요청하신 페이지 이 사이트 브라우저에서 계속하려면 잠시 후 홈으로 돌아가기 해 주세요 를 을 이용하려면 보려면 하세요 현재 서비스
""".split()

_NOUNS = ("javascript", "js", "scripts", "scripting", "script")
_VERBS = ("enable", "allow", "activate", "turn on", "switch on", "permit")
_STATES = ("disabled", "blocked", "turned off", "switched off", "off", "not enabled")
_LINKS = ("is", "are", "is currently", "are currently", "appears", "appear", "seems", "seems to be", "seem to be", "appears to be", "appear to be", "has been")
_WANTS = ("requires", "needs", "does not work without", "doesn't work without", "cannot be shown without", "cannot be displayed without", "will not work without", "relies on")


#: What is missed, and how. The ways tell, the things fill. Names of HTTP's error states come from the standard library.
_THINGS = ("page", "webpage", "web page", "video", "image", "application", "app", "product", "document you requested", "resource", "document", "file", "content", "article", "item", "site", "link", "url", "post")
_LACKS = ("not found", "cannot be found", "can't be found", "could not be found", "couldn't be found", "was not found", "does not exist", "doesn't exist", "isn't available", "is not available", "is unavailable", "is no longer available", "has expired", "has been removed", "has been deleted", "has been moved", "cannot be displayed", "can't be displayed", "can't be reached", "cannot be reached")
_SEEKS = ("can't find", "cannot find", "couldn't find", "could not find", "can't seem to find", "are unable to find")
_ENTRIES = ("sign in", "log in", "login")
_ENDS = ("to continue", "to view", "to access", "to your account", "to see", "to proceed")
_MORE_ERROR = """
page you were looking for|page you are looking for|page you're looking for|page you requested|page you tried|nothing was found at this location|requested url|server error in|http error|error code|gateway time-out|accessdenied|access to this page has been denied|has been denied|do not have access|don't have access|not have permission
must be signed in|must be logged in|need to be signed in|need to sign in|need to log in|not logged in|not signed in|been suspended|account is disabled|account has been disabled|account has been locked|session has ended|page has expired|change you wanted was rejected|temporarily down|down for maintenance|check back in a|be back shortly|back online soon
critical error on this website|internal error has occurred|an error has occurred|unexpected error|something broke|that's an error|encountered an error|unable to complete your request|unable to process your request|unable to load|failed to load|connection is not private|checking if the site connection is secure|just a moment|using a security service|automation tools|verify you are human|you are a robot|unusual traffic
you're trying to view|you are trying to view|you're trying to reach|couldn't find anything|no results found for|unable to service your request|could not be satisfied|proxy error|invalid response from an upstream|from an upstream server|request blocked|request has been blocked|can't connect to the server|cannot connect to the server|could not connect to the server|error establishing|connection lost|session was closed|signed out for security|verify your browser|accept cookies|cookies are disabled|invalid token|link is invalid
domain is for sale|domain is parked|welcome to nginx|site is under construction|under construction|default web page|isn't a github pages site
"""
_MORE_FILLER = """
welcome to wordpress|this is your first post|this is a sample page|is an example page|add your content here|add your text here|write your paragraph here|write something here|click to edit|click here to edit|enter your text here|enter text here|type your text here|edit this text|simply dummy text|of the printing and typesetting industry|sed ut perspiciatis|unde omnis iste natus|voluptatem accusantium|doloremque laudantium|quick brown fox jumps over the lazy dog
"""
_GOES_HERE = ("subheading", "content", "title", "description", "headline", "heading", "subtitle", "caption", "body", "quote", "name", "image", "link", "logo")
_MORE_WEAK = """
doesn't exist exists hello world welcome first post edit delete then writing click add paragraph write looks nothing was location maybe search oops uh can't couldn't that's broken followed mistyped address owner believe because security protect attacks secure moment human robot detected according configuration misconfiguration encountered complete completed
critical change wanted rejected team notified working fix issue issues soon shortly few hours visit homepage homepages go let us know tell support email them right private reached seem looking which might too late old bookmark outdated spelling typo checked correct url http https www com html php index nginx apache openresty cloudflare varnish guru meditation incident id ip port
hmm function properly finding having access token trouble web page properly enable cookie client get root
webpage video image app service request due capacity problems problem proxy received response invalid token close closed reasons wait verify accept cookies anything matching establishing connection lost industry ipsum error accusantium iste natus エラー しばらくしてから おつなぎ
account suspended locked administrator webmaster owner contact refreshing later again come back soon patience understanding thank currently busy overloaded capacity high traffic unable handle processing load failed loading required supported version modern newer recommended works best chrome firefox edge safari opera
""".split()
#: Fixed list: words of grammar, which alone tell nothing.
_GRAMMAR = """
about above across after again against all along also although always am among another anyone anything around because been before behind being below between both each either else enough ever every everyone everything few found further had he her him his however i including inside just least less like made make many maybe me might more most much my neither never new next none nor nothing often once only onto other others own per perhaps rather same say see several shall she should since some someone something such than their them themselves these they thing things those though three through thus together two under unless upon us very want way well what whatever whenever wherever whether which while who whole whom whose why within without yet
""".split()
_JP_THINGS = ("ページ", "コンテンツ", "ファイル", "サイト", "記事", "url")
_JP_LACKS = ("が存在しません", "は存在しません", "が見つかりません", "は見つかりません", "が表示できません", "は表示できません", "は削除されました", "にアクセスできません")
_JP_MORE = "現在アクセスできません|アクセスできません|サービスを停止しております|メンテナンスのお知らせ|メンテナンスを実施|メンテナンス作業を行って|ご利用いただけません|認証が必要です|javascriptを使用しています|スクリプトを使用しています"
_JP_TEXTS = ("テキスト", "文章", "本文", "内容", "説明", "文字", "タイトル", "見出し")


def _phrases() -> dict[str, list[str]]:
    split = lambda block: [p.strip() for line in block.strip().splitlines() for p in line.split("|") if p.strip()]
    script = split(SCRIPT)
    script += [f"{v} {n}" for v, n in product(_VERBS, _NOUNS)] + [f"{n} {k} {s}" for n, k, s in product(_NOUNS, _LINKS, _STATES)]
    script += [f"{w} {n}" for w, n in product(_WANTS, _NOUNS)] + [f"has {n} {s}" for n, s in product(_NOUNS, _STATES)]
    script += [f"browser {k} support {n}" for k, n in product(("does not", "doesn't", "did not"), _NOUNS)]
    script += [f"{v} {n} on" for v, n in product(("turn", "switch"), _NOUNS)] + [f"enable cookies and {n}" for n in _NOUNS]
    script += [f"{n} {s}" for n, s in product(_NOUNS, ("is not available", "must be enabled", "is required", "needs to be enabled", "must be on", *_STATES))]
    error = split(ERROR) + split(_MORE_ERROR) + split("whoops|looks like something went wrong") + [x.phrase.lower() for x in HTTPStatus if x >= 400 and " " in x.phrase]
    error += [f"{w} {d} {t}" for w, d, t in product(_SEEKS, ("the", "that", "this", "any"), _THINGS)]
    soft = [*_LACKS, *(f"{e} {t}" for e, t in product(_ENTRIES, _ENDS))]
    soft += [f"{a} {b}" for a, b in product(("unable to", "trouble", "problem", "problems", "failed to", "error while"), ("connect", "connecting", "find", "finding", "load", "loading", "open", "opening", "reach", "reaching", "display", "displaying", "save", "saving"))]
    error += [f"{t}{w}" for t, w in product(_JP_THINGS, _JP_LACKS)] + split(_JP_MORE)
    filler = [f"{v} {d}" for v, d in product(("add", "write", "type", "put", "insert", "paste", "place"), ("a", "an", "your", "some", "the"))]
    filler = [f"{a} {w} here" for a, w in product(filler, (*_GOES_HERE, "text", "paragraph", "subheading"))] + split(FILLER) + split(_MORE_FILLER) + [f"{t} goes here" for t in _GOES_HERE] + [f"ここに{t}{w}" for t, w in product((*_JP_TEXTS, "会社名", "氏名", "お名前", "住所", "日付", "電話番号", "件名"), ("を入力してください", "を記入してください", "を入力", "を書いてください", "が入ります"))]
    found = {"error": error + split(OTHER_ERROR), "filler": filler + split(OTHER_FILLER), "script": script + split(OTHER_SCRIPT), "soft": soft}
    return {kind: [fold(p) for p in phrases] for kind, phrases in found.items()}


@lru_cache(maxsize=1)
def _automaton():
    import ahocorasick

    a = ahocorasick.Automaton()
    words: dict[str, set[str]] = {}
    for kind, phrases in _phrases().items():
        for p in phrases:
            words.setdefault(p, set()).add(kind)
    for p in map(fold, (*WEAK["latin"], *WEAK["other"], *OTHER_WEAK, *_MORE_WEAK, *_GRAMMAR, *_THINGS)):
        words.setdefault(p, set())
    for p, kinds in words.items():
        a.add_word(p, (len(p), tuple(sorted(kinds))))
    a.make_automaton()
    return a


#: Characters of no width and of format, dropped before matching.
_HIDDEN = re.compile("[\u00ad\u200b-\u200f\u202a-\u202e\u2060-\u2064\ufe00-\ufe0f\ufeff]")
_LINE = re.compile("[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]+")
_PASSAGE = re.compile(r"(?<=[.!?])[\"')\]]*\s+|(?<=[。！？])|\s\|\s?|\t+")


#: What slots open with or hold, in folded text.
_OPENERS = ("{", "%", "[[", "<<", "<%", "@@", "____", "xxxx", "〇〇", "○○", "◯◯", "●●", "???", "tbd-", "記入", "入力", *(f"{b}{w}" for b in "[<" for w in ("insert", "your", "enter", "add", "fill", "type", "put", "select", "choose", "replace")))
_TELLING, _MOCKING, _OPENING_SLOT = 1, 2, 4


@lru_cache(maxsize=1)
def _tells():
    """Only what makes a text worth a closer look: telling phrases, words of mock text, and openings of slots."""
    import ahocorasick

    a = ahocorasick.Automaton()
    found: dict[str, int] = {}
    for phrases in _phrases().values():
        for p in phrases:
            found[p] = found.get(p, 0) | _TELLING
    for w in (*_MOCK.split("|"), "asdf", "qwer", "zxcv", "hjkl", "uiop", "foo bar"):
        if len(w) > 3:
            found[w] = found.get(w, 0) | _MOCKING
    for w in _OPENERS:
        found[w] = found.get(w, 0) | _OPENING_SLOT
    for w, what in found.items():
        a.add_word(w, (len(w), what))
    a.make_automaton()
    return a


#: A name in capitals and brackets (`[FIRST_NAME]`), which the automaton can't open on.
_CAPITALS = re.compile(r"(?<![\w\])])\[[A-Z][A-Z0-9]*(?:_[A-Z0-9]+)+\](?![\[(:])")
#: A word of a form in brackets (`[Customer Name]`), where no link or index follows.
_FORM = re.compile(r"(?<![\w\])])\[(?:[a-z]+[ ]){0,4}(?:name|date|title|address|company|e-?mail|phone|number|amount|position|signature|subject|recipient|city|country|time|location|department|reason|description)\](?![\[(\w])(?!:\s*\S+$)", re.I | re.M)


class _Plain(dict):
    """Letters that look like Latin ones as these, accents off; worked out once a character."""

    #: Cyrillic and Greek letters beside their Latin likes; quotes of one kind.
    LIKE = dict(zip("аеорсхуіѕјһԁո’ʼ‘αορν", "aeopcxyisjhdn'''aopv"))

    def __missing__(self, code: int) -> str:
        c = chr(code)
        base = unicodedata.normalize("NFD", c)[0] if code < 0x250 or 0x1E00 <= code < 0x1F00 else c
        self[code] = out = self.LIKE.get(c, base)
        return out


_plain_letters = _Plain()
_KATAKANA_NO = re.compile("(?<![ァ-ヶー])ノ|ノ(?![ァ-ヶー])")


def _clean(text: str) -> str:
    if text.isascii():
        return text
    return _HIDDEN.sub("", unicodedata.normalize("NFKC", re.sub("\u2028|\u2029|\x85", "\n", text)))


def fold(text: str) -> str:
    """NFKC and lower case, look-alike letters as plain ones, nothing invisible; line ends stay."""
    if text.isascii():
        return text.lower()
    t = unicodedata.normalize("NFC", _clean(text).lower())
    return t if t.isascii() else _KATAKANA_NO.sub("の", t.translate(_plain_letters))


def _is_latin(c: str) -> bool:
    return "a" <= c <= "z"


def _whole(s: str, first: int, last: int) -> bool:
    """Whether the match does not begin or end within a Latin word."""
    return not (_is_latin(s[first]) and first and _is_latin(s[first - 1]) or _is_latin(s[last]) and last + 1 < len(s) and _is_latin(s[last + 1]))


def _covered(passage: str) -> tuple[float, set[str]]:
    """Share of the letters that phrases cover, and the kinds of the telling ones; soft ones count as errors where hardly a letter is left."""
    n = len(passage)
    letters = np.fromiter((c.isalpha() for c in passage), bool, n)
    total = int(letters.sum())
    if not total:
        return 0.0, set()
    hit, kinds = np.zeros(n, bool), set()
    for last, (size, tells) in _automaton().iter(passage):
        a, b = last - size + 1, last + 1
        if not _whole(passage, a, last):
            continue
        hit[a:b] = True
        kinds.update(tells)
    share = int((hit & letters).sum()) / total
    if "soft" in kinds:
        kinds = kinds - {"soft"} | ({"error"} if share >= MIN_SOFT_COVERAGE else set())
    return share, kinds


#: Of any length, as the brackets excluded bound them; texts are given with one line end at most.
_SLOT = re.compile(
    r"(?P<jinja>\{\{[^{}()'\"|]+\}\})|(?P<dollar>\$\{\s*+[^{}\s]+\s*+\})|(?P<printf>%\([^()\s]+\)s)|(?P<hash>#\{[^{}]+\})|(?P<square>\[\[[^\[\]]+\]\])|(?P<angle><<[^<>]+>>)"
    r"|(?P<erb><%=[^<>%]+%>)|(?P<at>@@[^@\s]+@@)|(?P<percent>%[A-Z一-鿿ぁ-ヿ][A-Z0-9_一-鿿ぁ-ヿ]+%)|(?P<brace>(?<![A-Za-z0-9_$#%{\\])\{[^\S\n]*+[^\W\d_](?:[\w ]|\n(?=[^\S\n]*\w))*+[^\S\n]*+\}(?!\}))"
    r"|(?P<ask>[\[<](?:insert|your|enter|add|fill in|fill|type|put|select|choose|replace)\b[^\[\]<>]*[\]>])|(?P<blank>_{4,}|(?<![A-Za-z])X{4}(?![A-Za-z])|[〇○◯]{3,}|[●〇○◯]{2,}(?:株式会社|様|殿|御中)|\?\?\?-\?\?\?|(?<![A-Za-z])TBD-TBD(?![A-Za-z]))"
    r"|(?P<japanese>[(（【\[［][^()（）【】\[\]［］]*(?:[にを要未]\n?記入|[にを要]\n?入力)[^()（）【】\[\]［］]*[)）】\]］])",
    re.I,
)
#: What any slot has somewhere; lines without it are passed over.
_OPENING = re.compile(r"\{(?!%)|%[(A-Za-zぁ-鿿]|\[\[|<<|<%|@@|____|XXXX|xxxx|[〇○◯●]{2}|\?\?\?|TBD-|tbd-|記入|入力|[\[<](?:insert|your|enter|add|fill|type|put|select|choose|replace)", re.I)
_BRACKET = re.compile(r"[{<(（【\[［]")
#: Record fields of common loggers, which stand in formats and not in templates.
_LOGGING = {"asctime", "levelname", "message", "name", "lineno", "filename", "module", "funcname", "process", "thread", "pathname", "msecs", "created", "levelno"}
_COMMAND = re.compile(r"^\s*(?:\d+\.\s*)?(?:\$\s|export\s|cd\s|set\s|echo\s|cp\s|mv\s|source\s|alias\s|sudo\s|[A-Z_][A-Z0-9_]*=)")


def _lines(text: str) -> Iterator[tuple[str, bool]]:
    """Every line, and every two lines with one line end between them in which a slot may be broken (marked by True)."""
    at, last, end = 0, "", ""
    for m in [*_LINE.finditer(text), None]:
        line = text[at : m.start() if m else len(text)]
        yield line, False
        if end in ("\n", "\r", "\r\n") and _BRACKET.search(last):
            yield f"{last}\n{line}", True
        if m:
            at, last, end = m.end(), line, m.group(0)


def unfilled_slots(text: str) -> list[str]:
    """Slots of a form or template left unfilled; those of code, commands and settings aside."""
    found: list[str] = []
    cleaned = _clean(text)
    if not _OPENING.search(cleaned):
        return found
    for line, broken in _lines(cleaned):
        if not _OPENING.search(line):
            continue
        ticks = [m.start() for m in re.finditer("`", line)]
        command = bool(_COMMAND.match(line))
        for m in _SLOT.finditer(line):
            kind, s = m.lastgroup, m.group(0)
            if broken and "\n" not in s:
                continue  # found in its own line
            if sum(t < m.start() for t in ticks) % 2 and sum(t >= m.end() for t in ticks):
                continue  # quoted as code
            if kind == "percent" and not re.fullmatch(r"%[A-Z0-9_぀-ヿ一-鿿]+%", s):
                continue
            if kind == "blank" and s[:1] in "xX" and s != "XXXX":
                continue
            if kind == "printf" and s[2:-2].lower() in _LOGGING:
                continue
            if kind in ("dollar", "brace", "printf") and (command or line[m.end() : m.end() + 1] == "/" or line[max(0, m.start() - 1) : m.start()] in ("/", "=")):
                continue
            if kind == "brace" and re.search(r"\bf[\"'][^\"']*$", line[: m.start()]):
                continue
            found.append(s)
    return found


#: Filler that needs no words around it: one unit over and over, keyboard rows, mock Latin.
_MOCK = "lorem|ipsum|dolor|amet|arcu|velit|quis|porta|nunc|magna|tellus|eros|sit|elit|consectetur|adipiscing|sed|eiusmod|tempor|incididunt|labore|dolore|aliqua|vestibulum|curabitur|enim|minim|veniam|nisi|fusce|donec|viverra"
_WORDS = r"(?P<word>(?<![^\W_])(?P<w>[^\W\d_]{2,}+)(?:[\s,]+(?P=w)(?![^\W_])){3,}[.]?)"
_KANA = r"(?P<letter>(?P<l>[ぁ-んァ-ンー])(?P=l){6,})|(?P<unit>(?P<u>[ぁ-んァ-ヶー一-鿿]{2,8}?)(?P=u){2,})"
_MARKED = r"(?P<mark>(?<![^\W_])x{5,}(?:\s+x{3,})*(?![^\W_])|[●○■□◆◇]{5,}(?:\s*[●○■□◆◇x]{3,})*)"
_MOCKS = (
    r"(?P<foo>(?:\bfoo[\s,]+bar[\s,]+baz\b[\s,]*){2,}[.]?)|(?P<keys>(?:\b(?:asdf|qwer|zxcv|hjkl|qwerty|uiop|asdfgh|zxcvbn)\b[\s,]*){3,}[.]?)"
    rf"|(?P<mock>(?:\b(?:{_MOCK})\b[\s,]*){{5,}}[.]?)"
)
_MARKS = ("xxxxx", *(c * 5 for c in "●○■□◆◇"))
#: Any other sign or a digit over and over. Rules, dividers, leaders, fences, underlinings and stressed
#: marks are none, nor is a single run of asterisks, which is a divider too.
_SIGN = r"[^\w\s\-=.~+/\\#|:;,!<>^%'\"`·・‐-―─-╿]"
_GAP = r"[^\S\n\r]"
_REPEATED = (
    rf"(?P<signs>(?<!\S)(?:(?P<a>{_SIGN})(?P=a){{4,}}+(?:{_GAP}+(?P<b>{_SIGN}|[\dx])(?P=b){{4,}}+)+|(?P<c>\d)(?P=c){{4,}}+(?:{_GAP}+(?P<d>{_SIGN})(?P=d){{4,}}+)+)(?!\S))"
    rf"|(?P<whole>(?:(?<![^\n\r]){_GAP}*|(?<=[.!?]\s){_GAP}*|(?<=[。！？]){_GAP}*)(?:(?P<e>(?!\*){_SIGN}|\d)(?P=e){{4,}}+|(?P<f>{_SIGN}|\d)(?P=f){{4,}}+(?:{_GAP}+(?P<g>{_SIGN}|\d)(?P=g){{4,}}+)+)(?={_GAP}*(?:[\n\r]|\Z)))"
)


def _repeats(s: str) -> bool:
    """Whether some sign or digit of :data:`_SIGN` stands five times in a row; cheaper than to try the pattern."""
    cp = np.frombuffer(s.encode("utf-32-le", "surrogatepass"), np.uint32)
    pairs = cp[1:] == cp[:-1]
    fours = pairs[:-1] & pairs[1:]
    fives = np.flatnonzero(fours[:-2] & fours[2:])
    return any(re.match(rf"{_SIGN}|\d", chr(c)) for c in set(cp[fives].tolist())) if len(fives) else False


#: The parts of one pattern that a text can need: its repeated words, its Japanese, its marks, its repeated signs, its mock words.
@lru_cache(maxsize=None)
def _runs(*has: bool) -> re.Pattern | None:
    parts = [part for part, h in zip((_WORDS, _KANA, _MARKED, _REPEATED, _MOCKS), has) if h]
    return re.compile("|".join(parts)) if parts else None


def _periodic(line: str) -> bool:
    """Whether a line is one unit with letters at least three times over, whatever the unit's length. A sentence said again is none."""
    line = line.strip()
    if len(line) < 27 or line[: len(line) // 3] not in line[len(line) // 3 :]:
        return False
    if line[0] == line[(len(line) + 1) // 3] and " " in line:
        line += " "  # units with blanks between them
    at = (line + line).find(line, 1)
    return 8 < at <= len(line) // 3 and sum(c.isalpha() for c in line[:at]) > 4 and not re.search("[.!?。！？]", line)


#: Machine-made replies, which are passages of their own wherever they stand.
_REPLY = re.compile(r"(<noscript\b.*?</noscript>|<!doctype html.*?</html>|<html\b.*?</html>|\{\s*\"error\"\s*:.*?\}\s*\})", re.S)


def _passages(line: str) -> Iterator[str]:
    for part in _REPLY.split(line):
        if _REPLY.fullmatch(part):
            yield part
        else:
            for passage in _PASSAGE.split(part):
                if p := passage.strip().strip("|").strip():
                    yield p


def residue(text: str | None) -> tuple[list[str], float]:
    """The kinds of residue in a text (slot, filler, error, script) and the share of its letters in such passages."""
    if not text:
        return [], 0.0
    folded = fold(text)
    kinds: set[str] = set()
    what = n_telling = 0
    for last, (size, signs) in _tells().iter(folded):
        if signs == _OPENING_SLOT:
            what |= signs
        elif _whole(folded, last - size + 1, last):
            what |= signs
            n_telling += signs & _TELLING
    telling, mock = what & _TELLING, bool(what & _MOCKING)
    if what & _OPENING_SLOT and unfilled_slots(text) or "[" in text and (_CAPITALS.search(_clean(text)) or _FORM.search(_clean(text))):
        kinds.add("slot")
    parts, at, covered = [], 0, 0
    words = folded.replace(",", " ").split()
    again = any(len(w) > 1 and w.isalpha() for w in compress(words, map(str.__eq__, words, words[1:])))
    pattern = _runs(again, not folded.isascii(), any(x in folded for x in _MARKS), _repeats(folded), mock)
    for m in pattern.finditer(folded) if pattern else ():
        kinds.add("filler")
        covered += sum(c.isalpha() for c in m.group(0))
        parts.append(folded[at : m.start()])
        at = m.end()
    parts.append(folded[at:])
    rest = "\n".join(parts)
    for line in _LINE.split(rest):
        if _periodic(line):
            kinds.add("filler")
            covered += sum(c.isalpha() for c in line)
        elif telling or mock:  # passages of a text without a telling phrase need no look
            for p in _passages(line):
                n = sum(c.isalpha() for c in p)
                if n < 3:
                    continue
                share, tells = _covered(p)
                if tells and share >= MIN_COVERAGE:
                    kinds |= tells
                    covered += n
    if n_telling >= MIN_TELLING and not kinds:
        share, tells = _covered(rest)
        if share >= MIN_DOCUMENT_COVERAGE:
            kinds |= tells
            covered = int(share * sum(c.isalpha() for c in folded))
    if not kinds:
        return [], 0.0
    total = sum(c.isalpha() for c in folded)
    return sorted(kinds), covered / total if total else 1.0


def find_residue(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(doc_id, kinds, coverage) of every document with residue; the rest has no row.

    ``coverage`` is the share of the document's letters that lie in residue passages (slots add
    none). Null, empty, blank and short texts as such are no residue. One row a document row,
    repeated ones included; rows with a null id come out with it; texts are read whole. One pass
    in Arrow batches beside the scan, without a shuffle unless the table has fewer partitions than cores.
    """
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, kinds, shares = [], [], []
            for i, t in enumerate(b.column("text").to_pylist()):
                k, share = residue(t)
                if k:
                    at.append(i)
                    kinds.append(k)
                    shares.append(share)
            yield pa.RecordBatch.from_arrays([b.column("doc_id").take(pa.array(at, pa.int64())), pa.array(kinds, pa.list_(pa.string())), pa.array(shares, pa.float64())], names=["doc_id", "kinds", "coverage"])

    src = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return spread(src).mapInArrow(run, f"doc_id {dict(src.dtypes)['doc_id']}, kinds array<string>, coverage double").withColumnRenamed("doc_id", doc_id)
