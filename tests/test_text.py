"""Text and URL functions on small known inputs, with the Chinese default rules."""

from pyspark.sql import functions as F

from talkweave.functions import links as lk
from talkweave.functions import scoring as sc
from talkweave.functions import text as tx
from talkweave.functions import urls as ux
from talkweave.functions.html import html_to_text, unescape
from talkweave.functions.pandas_udfs import bounded_ratio, page_outline


def test_mojibake_and_normalisation(evaluate):
    broken = "高斯安装".encode().decode("latin-1")
    assert evaluate(tx.repair_mojibake, broken, "été à Paris", "plain") == ["高斯安装", "été à Paris", "plain"]
    assert evaluate(tx.normalize_text, "a​ b  \r\nc\n\n\n\nd　") == "a b\nc\n\nd"
    assert evaluate(tx.clean_page_title, "教程 ｜ 站点") == "教程"


def test_file_names(evaluate):
    assert evaluate(tx.sanitize_filename, " a/b: c  d🤝 ", "", "的" * 80 + "x") == ["ab-c-d", "未命名", "未命名"]
    assert evaluate(lambda c: tx.sanitize_filename(c, 4), "高斯软件的安装") == "高斯软件"
    assert evaluate(tx.faq_core_title, "您好，高斯16如何安装？？", "@客服 在吗？", "？") == ["高斯16如何安装", "在吗", "未命名问题"]
    assert evaluate(tx.category_slug, "科学软件（Gaussian / VASP）") == "科学软件-Gaussian-VASP"


def test_url_extraction(evaluate):
    text = "请看 https://example.com/a.png 和 https://foo.com/page?id=1 ，谢谢"
    both = ["https://example.com/a.png", "https://foo.com/page?id=1"]
    assert evaluate(ux.extract_urls_distinct, text) == both
    assert evaluate(ux.extract_urls, text + " https://foo.com/page?id=1。") == both + both[1:]
    assert evaluate(ux.extract_urls, "https://a.cn/路径") == ["https://a.cn/"]
    doc = "---\nsession_id: x\nfile_urls:\n  - \"https://f.cn/1.png\"\n  - 'https://f.cn/2'\n---\n\n见 https://f.cn/2 与 https://g.cn"
    assert evaluate(ux.session_urls, doc) == ["https://f.cn/1.png", "https://f.cn/2", "https://g.cn"]


def test_url_kinds(evaluate):
    assert evaluate(ux.url_kind, "https://cdn.example.com/x.jpeg", "https://example.com/docs/guide") == ["image", "page"]
    safe = evaluate(ux.is_safe_url, "https://example.com/x", "http://127.0.0.1/secret", "http://10.1.2.3", "http://[::1]/", "http://[fd00::1]/",
                    "ftp://a.b", "http://172.32.0.1", "http://x.local", "https://user@192.168.0.1:80/a")
    assert safe == [True, False, False, False, False, False, True, False, False]
    assert evaluate(ux.url_extension, "https://a.b/c.PNG?x", "https://a.b/get?fileName=%E5%9B%BE.jpg", "https://a.b/") == [".png", ".jpg", ""]


def test_url_labels_and_resolution(evaluate, spark):
    assert evaluate(ux.url_path_label, "https://x/ac/openapi/doc/2.0/moduleapi/apiCall.html", "https://x/help/docs/", "https://x/a/userGuide/fooBar_baz") == [
        "API调用", "首页", "user-Guide-foo-Bar-baz"]
    rows = spark.createDataFrame([("https://h.cn/a/b?x=1#f", h) for h in ("../c", "/d#z", "?q=2", "//o.cn/e", "https://k/", "g/./h", "#top")], "b string, h string")
    got = [r[0] for r in rows.select(ux.resolve_url(F.col("b"), F.col("h"))).collect()]
    assert got == ["https://h.cn/c", "https://h.cn/d", "https://h.cn/a/b?q=2", "https://o.cn/e", "https://k/", "https://h.cn/a/g/h", "https://h.cn/a/b?x=1"]
    keep = evaluate(lambda c: ux.crawlable_url(c, F.lit("https://h.cn/"), "/docs"), "https://h.cn/docs/a", "https://h.cn/docs/a.pdf", "https://h.cn/docs/login", "https://o.cn/docs/a", "https://h.cn/docs?x=1", "https://h.cn/b")
    assert keep == [True, False, False, False, False, False]
    assert evaluate(ux.url_category, "https://x/ac/openapi/doc/a/moduleapi/llm", "https://x/help/docs/openclaw/", "https://x/help/docs/q", "https://x/") == [
        "ai-maas-openapi", "openclaw-integration", "platform-intro", "platform-intro"]


def test_noise_and_politeness(evaluate):
    assert evaluate(tx.is_noise, "好的", "好的，我试试", "谢谢老师", "[咖啡][强]", "x", "NaN", "座席小王关闭会话", "高斯怎么装") == [
        True, False, True, True, True, True, True, False]
    assert evaluate(tx.is_politeness_only, "已经开通，谢谢", "", "[抱拳]好", "请稍等") == [True, True, True, False]
    score = lambda role: lambda c: tx.substantive_score(F.lit(role), c)
    assert evaluate(score("访客"), "高斯怎么装", "怎么装", "见 https://a.cn") == [1, 0, 2]
    assert evaluate(score("客服"), "点击这里安", "点击这里安装") == [0, 1]


def test_meaningful_text(evaluate):
    assert evaluate(tx.is_meaningful_text, "在控制台点击开通按钮后等待十分钟即可使用该软件服务", "> 引用的内容很长很长很长很长很长很长很长很长", "1234-5678:90.12345678901234", None) == [
        True, False, False, False]
    assert evaluate(tx.is_meaningful_ocr_text, "这是一段足够长的识别文字内容用于测试", "短", "第 3 页") == [True, False, False]


def test_segments_and_sections(evaluate):
    assert evaluate(tx.punct_segments, "你好，世界。", "仅一段") == [["你好，", "世界。"], ["仅一段"]]
    assert evaluate(lambda c: tx.punct_segments(c, 10), "abcdefghijklmnop") == ["abcdefghij", "klmnop"]
    assert evaluate(tx.sentences_by_stop, "一。二。", " ") == [["一", "二"], ["收到你的问题。"]]
    assert evaluate(tx.standard_answer, "# q\n## 标准回答\n\n先登录\n再点击\n\n## 相关\n- x", "## 标准回答\n末尾") == ["先登录\n再点击", "末尾"]


def test_keys_and_ids(evaluate):
    assert evaluate(tx.normalize_question, "如何 安装【高斯】？") == "如何安装高斯"
    assert evaluate(tx.norm_faq_key, "问答-如何安装-a1b2c3.md", "问答-如何（安装）") == ["如何安装", "如何安装"]
    assert evaluate(tx.alias_key, "概念-A　B--c.md") == "概念-AB-c"
    assert evaluate(tx.soft_alias_key, "概念-A·B（x）") == "概念-AB（x）"
    assert evaluate(tx.extraction_session_id, "session_a-b-c-d-e-170", "session_abc", "other") == ["a-b-c-d-e", "abc", "other"]
    assert evaluate(tx.session_slug, "A.b c/中文") == "a-b-c-中文"


def test_keywords_and_titles(evaluate, spark):
    kw = evaluate(sc.extract_keywords, "422 Model Not Exist 错误，模型不存在，如何解决？")
    assert {"model", "exist", "模型", "不存在"} <= set(kw) and len(kw) <= 40
    rows = spark.createDataFrame([("账户充值与计费", "试用期限和计费"), ("科学软件与许可证", "openclaw使用期限"), ("Slurm jobs", "my slurm queue"), ("a b", "a b")], "t string, q string")
    assert [r[0] for r in rows.select(sc.title_matches_question(F.col("t"), F.col("q"))).collect()] == [True, False, True, False]


def test_links(evaluate):
    text = "[[问答-a|x]] [[ 概念-b.md ]] [[${v}]] ```[[问答-c]]``` [[.agent-queue/d]] [t](../faqs/e.md#s) [u](http://x/f.md) [v](./concepts/g.md)"
    assert evaluate(lk.wikilinks, text) == ["问答-a", "概念-b"]
    assert evaluate(lk.md_rel_links, text) == ["e", "g"]
    assert evaluate(lk.typed_wikilinks, "[[分类-x（y）]] [[分类-x]] [[其他-z]]") == ["分类-x"]


def test_time_bounds(evaluate):
    low = evaluate(lambda c: F.date_format(tx.parse_time_bound(c), "yyyy-MM-dd HH:mm:ss"), "2024-05-01", "2024-05-01T08:00:00+08:00", "2024-05-01T08:00:00", "")
    assert low == ["2024-05-01 00:00:00", "2024-05-01 00:00:00", "2024-05-01 08:00:00", None]
    assert evaluate(lambda c: F.date_format(tx.parse_time_bound(c, True), "HH:mm:ss"), "2024-05-01") == "23:59:59"


def test_visible_text(evaluate):
    shown = evaluate(html_to_text, "<html><script>bad()</script><body><h1>标题</h1><p>正文</p></body></html>", "a<!-- <b>x</b> -->b<br title='1>0'>c &amp;lt; d<style>p{}</style><SCRIPT>x", None, " plain ")
    assert shown == ["标题\n正文", "a\nb\nc &lt; d", "", "plain"]
    assert evaluate(unescape, "&#20013;&#x6587; &#128512; &#0; &# &lt;b&gt; a&amp;b&nbsp;c &am") == "中文 😀 &#0; &# <b> a&b\u00a0c &am"


def test_html():
    title, body, h2 = page_outline(
        "<title>T</title><body><nav><p>menu</p></nav><article><h1>T</h1><h2>Part</h2><p>one<p>two<ul><li>x</li></ul><pre>a\nb</pre></article><p>after</p></body>")
    assert (title, h2) == ("T", ["Part"])
    assert body == "# T\n\n## Part\n\none\n\ntwo\n\n- x\n\n```\na\nb\n```"


def test_ratio_bound_is_exact():
    import random
    from difflib import SequenceMatcher

    rng = random.Random(7)
    for _ in range(400):
        a, b = ("".join(rng.choice("abcd高斯") for _ in range(rng.randint(1, 25))) for _ in range(2))
        want = SequenceMatcher(None, a, b).ratio()
        for t in (0.4, 0.68, 0.9):
            got = bounded_ratio(a, b, t)
            assert got == want or (got == 0.0 and want < t)


def test_sound_level(spark):
    import struct

    from pyspark.sql import functions as F

    from talkweave.functions.sound import rms

    waves = [b"", b"\x01", struct.pack("<3h", 100, -32768, 32767), struct.pack("<2h", -5, 5) + b"\x07", None]
    got = [r.x for r in spark.createDataFrame(list(enumerate(waves)), "i int, c binary").orderBy("i").select(F.coalesce(rms(F.col("c")), F.lit(0.0)).alias("x")).collect()]
    want = [0.0, 0.0, ((100**2 + 32768**2 + 32767**2) / 3) ** 0.5 / 32768, 5 / 32768, 0.0]
    assert all(abs(a - b) < 1e-12 for a, b in zip(got, want))


def test_sound_level_is_no_row_by_row_expression(spark):
    from pyspark.sql import functions as F

    from talkweave.functions.sound import rms

    plan = spark.createDataFrame([(b"\x01\x02",)], "c binary").select(rms(F.col("c")).alias("level"))._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_extract_all" not in plan and "conv(" not in plan


def test_safe_url_reads_the_host_once(spark):
    from pyspark.sql import functions as F

    from talkweave.operators import render as rd

    rows = spark.createDataFrame([(1, "see http://10.0.0.1/x and https://doc.example/a")], "k int, text string")
    plan = rows.select(ux.is_safe_url(F.col("text")).alias("safe"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract(") < 12
    contents = spark.createDataFrame([("https://doc.example/a", "page", "body", None)], "url string, kind string, content string, error string")
    out = rd.attach_link_content(rows, contents, ["k"])
    assert out._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract(") < 20
    got = out.collect()[0]
    assert (got.n_links, got.failed) == (2, 1) and "body" in got.text
