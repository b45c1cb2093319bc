import pytest
from pyspark.sql import functions as F

from tallyforge.llm.residue import find_residue, residue, unfilled_slots

NOTE = "Late rows for 2024-05 arrived with the next delivery and moved the sum by 613. "

HOLDS = [
    ("slot", "- Reviewer code: ________\n- Packet ID: ________"), ("slot", "Dear {{ name }}, the packet is ready."), ("slot", NOTE + "Kindly return the worksheet by [[date]]."), ("slot", "判定者は{担当者名}、所要時間は4分。"), ("slot", "2024-05の返金は%金額%円です。"),
    ("slot", "The relation of <%= a %> to b was checked by @@who@@."), ("slot", "%(plan)s 様"), ("slot", "#{plan} 様"), ("slot", "decisive lines ${lines};"), ("slot", "- Reviewer code: TBD-TBD"), ("slot", "Return it by <fill in>."), ("slot", "根拠：(根拠行を入力してください)"), ("slot", "by [insert due date]."),
    ("filler", "Lorem ipsum dolor sit amet arcu velit."), ("filler", NOTE + "Text text text."), ("filler", "ここに説明が入ります。"), ("filler", "asdf qwer zxcv hjkl " + NOTE), ("filler", "blah blah blah blah"), ("filler", "ああああああああああ"), ("filler", "Here stands dummy copy left here until the final wording is approved."),
    ("error", "<html><head><title>502 Bad Gateway</title></head><body><center><h1>502 Bad Gateway</h1></center><hr></body></html> " + NOTE), ("error", "404 Not Found"), ("error", NOTE + "\nAccess denied. You don't have permission to view this worksheet."), ("error", '{"error": {"code": 503, "message": "service unavailable", "request": "af12"}} ' + NOTE),
    ("error", "Your session has expired. Sign in again to continue."), ("error", "ただいまメンテナンス中です。トップへ戻る"), ("error", "We looked everywhere for the page you asked for."), ("error", "ＯＯＰＳ！ Something went wrong."),
    ("script", "Please enable JavaScript to continue."), ("script", "このページを表示するにはJavaScriptを有効にする必要があります。"), ("script", "<noscript>Your browser has JS off, so the list is not loaded.</noscript>" + NOTE), ("script", "This page does not work without scripts."),
]

CLEAN = [
    None, "", " \n\t", "ok", "了解。", NOTE, "12 requests ended in 503 Service Unavailable during the 2024-05 load; all were repeated with success.", "Access denied was the reply of the warehouse until role reader_1 got a grant on fct_orders.", "The link in the packet gave a 404, so I read it from my clone instead.",
    "「ページが見つかりません」と出た場合は、手元の複製のL3-9を参照した。", "JavaScriptを無効にしていた審査者が2名いたが、結果に影響はない。", "The project's docs site needs JavaScript enabled in the browser, otherwise use the clone at L10-12.", "QA note: earlier exports still had lorem ipsum in the description of net_cost; it has been replaced.", "ダミーの文章は3-1の版ですべて差し替え済み。",
    "The reviewer asked whether the placeholder in the template, written in double braces, must be kept; the answer was no.", "from {{ ref('orders') }}", "{{ config(materialized='table') }}", "where x >= '{{ var(\"start_date\") }}'", "1. export DATA_PATH=${HOME}/x.duckdb", "Go to the clone: `cd ${WORK_DIR}/x` and check.", "Log format: `%(asctime)s %(levelname)s %(message)s`.", 'f"{n} lines changed" is printed',
    "Set {a, b} of groups: rows missing on one side count as empty, see [1].", "Run `mf query --metrics <metric> --group-by <dimension>`.", "An empty label cell for MP-1 is allowed, because the status is needs_review.", "| MP-1 | related |  | needs_review |", "<|endoftext|>",
]


@pytest.mark.parametrize(("kind", "text"), HOLDS)
def test_residue_is_found(kind, text):
    assert residue(text)[0] == [kind]


@pytest.mark.parametrize("text", CLEAN)
def test_content_is_kept(text):
    assert residue(text) == ([], 0.0) if not text or not text.strip() else residue(text)[0] == []


def test_operator(spark):
    long = NOTE * 3000
    data = [(i, t) for i, (_, t) in enumerate(HOLDS)] + [(1000 + i, t) for i, t in enumerate(CLEAN)] + [(0, HOLDS[0][1]), (None, "404 Not Found"), (5000, long), (5001, long + "Please enable JavaScript to continue.")]
    df = spark.createDataFrame(data, "doc_id bigint, text string").withColumn("kinds", F.lit("clash"))
    got = find_residue(df, "doc_id", "text").collect()
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in got) == sorted([(False, i) for i in range(len(HOLDS))] + [(False, 0), (True, 0), (False, 5001)])
    shares = {r.doc_id: r.coverage for r in got}
    assert shares[5001] < 0.001 and shares[HOLDS.index(("error", "404 Not Found"))] == 1.0
    assert find_residue(df.limit(0), "doc_id", "text").count() == 0
    assert unfilled_slots("no slots") == []


@pytest.mark.parametrize("text", ["it was sent.\n\n*************** 0000000", NOTE + " ********* 00000000000 time behaviour differs", "0000000 *****", "***** *******", "0000000000", "集計は済んだ。 ********* 000000", "?????\n"])
def test_repeated_signs_are_filler(text):
    assert residue(text)[0] == ["filler"]


@pytest.mark.parametrize("text", ["-----", "===== =====", "| ----- | ----- |", "*****\nlate rows", "MP-00000205 moved by 100000", "......", "| MP-1 | 00000 | kept |", "the codes 00000 11111 were used", "a /***** note *****/ b"])
def test_dividers_and_values_are_kept(text):
    assert residue(text)[0] == []


LONG = "the name of the reviewer who kept the last evidence line of the packet"


@pytest.mark.parametrize("text", [f"{{{{ {LONG} }}}}", f"[[{LONG}]]", f"<<{LONG}>>", f"{{{LONG}}}", f"#{{{LONG}}}", f"[insert {LONG}]", "(判定を変えた場合はその理由と根拠にした行の番号も含めてこの欄に入力してください)", "Dear {{ first\nname }}, hello.", "by [insert\r\ndue date].", "{first\n name} 様", "（理由を\n入力してください）"])
def test_long_and_broken_slots(text):
    assert residue(text)[0] == ["slot"] and len(unfilled_slots(text)) == 1


@pytest.mark.parametrize("text", ["by [insert\n\ndue date].", "{{ first\n\nname }}", "else {\n  leave\n}", "see `{{ a\nb }}` here", "[[" + "a" * 50, "{" + " " * 50_000 + "\n", "#{" + " " * 50_000, "({" * 20_000 + "\n" + "[<" * 20_000])
def test_no_slot_over_paragraphs(text):
    assert unfilled_slots(text) == []


LANGUAGES = [
    ("error", "Seite nicht gefunden. Die angeforderte Seite konnte nicht gefunden werden."), ("error", "Zugriff verweigert. Sie haben keine Berechtigung für diese Seite."), ("error", "Ihre Sitzung ist abgelaufen. Bitte melden Sie sich erneut an."), ("script", "Bitte aktivieren Sie JavaScript, um fortzufahren."), ("filler", "Dies ist ein Blindtext."),
    ("error", "Page introuvable. La page demandée est introuvable."), ("error", "Accès refusé"), ("error", "Une erreur est survenue. Veuillez réessayer plus tard."), ("script", "Veuillez activer JavaScript pour continuer."), ("filler", "Texte de remplissage"),
    ("error", "Página no encontrada"), ("error", "Ha ocurrido un error. Inténtelo de nuevo más tarde."), ("error", "Su sesión ha caducado. Inicie sesión de nuevo."), ("script", "Por favor, habilite JavaScript en su navegador."), ("error", "Pagina non trovata"), ("error", "Acesso negado"), ("error", "Er is een fout opgetreden. Probeer het later opnieuw."),
    ("error", "Страница не найдена"), ("error", "Доступ запрещён"), ("error", "抱歉，您访问的页面不存在。"), ("error", "服务器内部错误，请稍后再试。"), ("script", "请启用 JavaScript 以继续浏览此网站。"), ("error", "죄송합니다. 요청하신 페이지를 찾을 수 없습니다."), ("error", "세션이 만료되었습니다. 다시 로그인해 주세요."), ("script", "이 사이트를 이용하려면 JavaScript를 활성화하세요."),
    ("script", "Your browser does not support JavaScript."), ("error", "Whoops, looks like something went wrong."), ("slot", "Dear [FIRST_NAME], the packet is ready."), ("slot", "（判定を変えた理由を記入してから、根拠の行番号もあわせて必ずこの欄に書くこと）"),
    ("filler", "documentation documentation documentation documentation documentation"), ("filler", "ここにはまだ何も書かれていない文 ここにはまだ何も書かれていない文 ここにはまだ何も書かれていない文"),
]


@pytest.mark.parametrize(("kind", "text"), LANGUAGES)
def test_other_languages_and_any_length(kind, text):
    assert kind in residue(text)[0] and kind in residue(NOTE + "\n" + text)[0]


@pytest.mark.parametrize("text", [
    "Der Link im Paket ergab nur »Seite nicht gefunden«, daher habe ich die Zeilen 3 bis 9 aus dem Klon gelesen.", "Le prestataire a répondu « accès refusé » jusqu'à ce que le rôle reader_1 reçoive un droit sur fct_orders.", "El informe cuenta doce páginas no encontradas y tres sesiones caducadas durante la carga de mayo.", "审核员报告说，在五月的加载过程中有十二个请求因为服务器内部错误而失败，之后全部重试成功。",
    "审查说明第三节提到，链接打开后显示页面不存在，因此引用了本地副本。", "보고서에 따르면 5월 적재 중 열두 건의 요청이 서버 오류로 실패했으나 모두 다시 성공했다.", "see [MAX_ROWS](docs) and a[MAX_ROWS] and [MAX_ROWS]: 5", "比率は分けて割る。比率は分けて割る。比率は分けて割る。比率は分けて割る。", "| active | active | active | active |", "12% of rows, 13 %d",
])
def test_reports_in_other_languages_are_kept(text):
    assert residue(text)[0] == []


def test_coverage_of_the_whole_document():
    page = "Internal server error, zone kfw eight\nService unavailable at node qxv\nTry again later, refresh the page or go back home"
    kinds, share = residue(page)
    assert kinds == ["error"] and share >= 0.7
    assert residue(NOTE * 3 + "\n" + page)[0] == []  # amid content a passage must be covered by itself


#: Texts as widely used software shows them, and sentences that only report on such.
COMMON = ["The requested URL was not found on this server.", "Not Found\nThe requested URL /index.html was not found on this server.", "Forbidden\nYou don't have permission to access this resource.", "503 Service Temporarily Unavailable", "504 Gateway Time-out", "Internal Server Error\nThe server encountered an internal error or misconfiguration and was unable to complete your request.", "Error 1020: Access denied. This website is using a security service to protect itself from online attacks.", "Checking if the site connection is secure", "Just a moment...", "Please turn JavaScript on and reload the page.", "You need to enable JavaScript to run this app.", "This site requires JavaScript. Please enable it in your browser settings.", "JavaScript is not available. We've detected that JavaScript is disabled in this browser.", "It looks like nothing was found at this location. Maybe try a search?", "Oops! That page can’t be found.", "Briefly unavailable for scheduled maintenance. Check back in a minute.", "There has been a critical error on this website.", "We're sorry, but something went wrong.", "The page you were looking for doesn't exist. You may have mistyped the address or the page may have moved.", "The change you wanted was rejected.", "HTTP Error 404.0 - Not Found", "Server Error in '/' Application.", "The resource cannot be found.", "<Error><Code>AccessDenied</Code><Message>Access Denied</Message></Error>", "There isn't a GitHub Pages site here.", "Site not found", "This page isn’t available", "Sorry, this page isn't available. The link you followed may be broken, or the page may have been removed.", "This content isn't available right now", "Log in to your account to continue.", "Your session has timed out. Please log in again.", "You must be signed in to view this page.", "This account has been suspended.", "This domain is for sale.", "Hello world! Welcome to WordPress. This is your first post. Edit or delete it, then start writing!", "Lorem ipsum dolor sit amet, consectetur adipiscing elit, sed do eiusmod tempor incididunt ut labore et dolore magna aliqua.", "[Your Name Here]", "Dear {{customer_name}},", "Hi %FIRST_NAME%,", "Insert text here", "Add your content here", "Click to edit this text.", "<<COMPANY NAME>>", "Name: ____________", "Date: [DATE]", "xxxxxxxxxxx", "Enter your text here...", "This is a sample page.", "Sorry, we couldn't find that page.", "We can't seem to find the page you're looking for.", "Your connection is not private", "This site can’t be reached", "Too many requests. Please try again later.", "The service is temporarily unavailable. Please try again later.", "Please enable cookies and JavaScript to continue.", "Enable JavaScript and cookies to continue", "You do not have access to this page.", "Access to this page has been denied because we believe you are using automation tools.", "An internal error has occurred.", "Something broke! Please refresh the page.", "We are currently down for maintenance. We'll be back shortly.", "Please sign in to view this document.", "The page has expired. Please refresh and try again.", "${first_name}, your order is ready.", "Dear [Customer Name],", "Write your paragraph here.", "Placeholder text for the description goes here.", "asdf asdf asdf asdf", "500 Internal Server Error\nnginx/1.18.0", "ページが存在しません。", "現在アクセスできません。", "ご指定のページは見つかりませんでした。", "サーバーメンテナンスのお知らせ：ただいまサービスを停止しております。", "このサイトではJavaScriptを使用しています。ブラウザの設定で有効にしてください。", "ここにテキストを入力してください。", "【氏名を記入】", "○○○株式会社", "ダミーダミーダミーダミー", "We couldn’t find anything matching your search.", "Sorry! The page you're trying to view is unavailable.", "Uh oh. That page can't be found.", "HTTP 403: Forbidden", "This video is unavailable", "The server is temporarily unable to service your request due to maintenance downtime or capacity problems. Please try again later.", "Proxy Error: The proxy server received an invalid response from an upstream server.", "The request could not be satisfied. Bad request.", "Request blocked. We can't connect to the server for this app or website at this time.", "This webpage is not available", "Error establishing a Redis connection", "Invalid token. Please log in again.", "For security reasons your session was closed. Sign in again.", "Please wait while we verify your browser...", "Your browser must accept cookies to view this page.", "This application requires scripts to be enabled.", "Lorem Ipsum is simply dummy text of the printing and typesetting industry.", "Sed ut perspiciatis unde omnis iste natus error sit voluptatem accusantium doloremque laudantium", "The quick brown fox jumps over the lazy dog.", "Dear {Name},", "Hello <%= user.name %>", "Sehr geehrte/r [Name],", "Test test test test", "qwerty qwerty qwerty", "Headline goes here", "お使いのブラウザではJavaScriptが無効になっています。", "申し訳ございません。このページは現在ご利用いただけません。", "エラー：しばらくしてからもう一度お試しください。", "ここに会社名を入力", "●●株式会社 ●●様"]
REPORTS = ["The vendor's page was not found in the archive until the clerk restored it from tape.", "We could not find the invoice in March, so the total stays open.", "The article has been removed from the price list after the audit.", "Please sign in at the front desk before the meeting starts at nine.", "The account has been suspended since May; its last invoice was paid in full.", "Her session has expired memberships listed by club and year.", "Enable JavaScript linting in the build to catch unused variables early.", "The document does not exist in the archive for 2021, but a copy was found in the annex.", "File not found errors rose by 12 percent after the disk swap.", "The site is under construction and the crane arrives on Monday.", "Maintenance of the lift takes place twice a year.", "The link between churn and price is not available for small accounts.", "予算の資料が見つかりませんでしたので、経理に再送を依頼しました。", "サイトの売上は前年より三割増えた。", "The content is no longer available to subscribers who left before June; they were told by mail.", "No item was found to be above the limit, so all rows were kept.", "Log in to your account to continue was the wording that testers liked least.", "A moment later the meeting moved to the second floor.", "Kindly add your name and the date at the end of the list before Friday noon.", "We are unable to process your request for leave before the payroll closes, as agreed in the contract."]


@pytest.mark.parametrize("text", COMMON)
def test_common_texts(text):
    assert residue(text)[0]


@pytest.mark.parametrize("text", REPORTS)
def test_reports_are_kept(text):
    assert residue(text)[0] == []
