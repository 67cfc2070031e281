"""Six small sessions: meaningful, visitor only, polite only, noise only, link only, multi-line."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from talkweave import rules
from talkweave.operators import faq as fq
from talkweave.operators import messages as ms
from talkweave.sources.readers import normalize_chat_columns, parse_session_docs, read_chat_messages, session_messages

T0 = dt.datetime(2024, 1, 1)
SESSIONS = {
    "s1": [(2, "请问高斯16如何安装在集群上？"), (1, "您好"), (1, "请先登录平台，点击软件中心选择高斯并开通许可"), (2, "安装后报错怎么处理呢"), (1, "请提供作业号，我们帮您查看日志文件")],
    "s2": [(2, "有人吗，我想问一下资源"), (2, "没人回复我吗请回答")],
    "s3": [(2, "怎么充值账户余额呢"), (1, "已经处理好，谢谢")],
    "s4": [(2, "好的"), (1, "收到")],
    "s5": [(2, "教程在哪里可以看"), (1, "https://doc.cn/a.html")],
    "s6": [(2, "如何下载文件到本地"), (1, "第一步打开文件管理\n第二步点击下载按钮"), (3, "会话已关闭")],
}


@pytest.fixture(scope="module")
def chats(spark):
    rows = [(s, i, k, c, T0 + dt.timedelta(minutes=i), None, None) for s, ms_ in SESSIONS.items() for i, (k, c) in enumerate(ms_)]
    return spark.createDataFrame(rows, "session_id string, msg_id bigint, sender_type int, content string, created_at timestamp, file_url string, sensitive_word string")


def test_meaningful_sessions(chats):
    kept = ms.meaningful_sessions(ms.clean_messages(chats))
    assert {r.session_id for r in kept.select("session_id").distinct().collect()} == {"s1", "s5", "s6"}
    strict = ms.meaningful_sessions(ms.clean_messages(chats), first_line_only=True)
    assert {r.session_id for r in strict.select("session_id").distinct().collect()} == {"s1", "s5"}


def test_flagged_and_short_sessions(chats):
    flagged = chats.withColumn("sensitive_word", F.when(F.col("session_id") == "s1", "x"))
    assert ms.clean_messages(flagged).filter("session_id = 's1'").count() == 0
    assert {r.session_id for r in ms.min_messages(chats, 3).select("session_id").distinct().collect()} == {"s1", "s6"}


def test_headers_count_raw_messages(chats):
    rows = {r.session_id: r for r in ms.build_sessions(chats).collect()}
    assert rows["s6"].message_count == 3 and rows["s6"].kept_count == 2
    assert rows["s1"].message_count == 5 and rows["s1"].kept_count == 4


def test_summary(chats):
    cleaned = ms.clean_messages(chats)
    rows = {r.session_id: r for r in ms.session_summary(chats, cleaned).collect()}
    s1 = rows["s1"]
    assert s1.value == "medium" and s1.tags == ["高斯", "资源配置", "软件许可", "作业提交", "网络连接", "数据存储"]
    assert s1.title == "请问高斯16如何安装在集群上？（高斯）"
    assert s1.summary == ("访客诉求：请问高斯16如何安装在集群上？ 客服处理：请先登录平台，点击软件中心选择高斯并开通许可；请提供作业号，我们帮您查看日志文件")
    assert s1.key_points[0] == "访客：请问高斯16如何安装在集群上？" and s1.key_points[-1].startswith("客服：请提供作业号")
    assert s1.procedure_points == ["请先登录平台，点击软件中心选择高斯并开通许可"]
    assert rows["s6"].procedure_points == ["第一步打开文件管理 第二步点击下载按钮"]


def test_extract_faq(chats):
    rows = {r.session_id: r for r in fq.extract_faq(ms.clean_messages(chats)).collect()}
    assert set(rows) == {"s1", "s5", "s6"}
    s1 = rows["s1"]
    assert s1.question == "请问高斯16如何安装在集群上？" and s1.question_variants == ["安装后报错怎么处理呢"]
    assert s1.answer == "请先登录平台，点击软件中心选择高斯并开通许可\n\n请提供作业号，我们帮您查看日志文件"
    assert s1.category_id == "software-license" and s1.steps == ["请先登录平台，点击软件中心选择高斯并开通许可"]
    assert rows["s5"].links == ["https://doc.cn/a.html"]


def test_weak_answers_fall_back_to_last_two(spark):
    rows = [("w", i, k, c, T0 + dt.timedelta(minutes=i), None, None) for i, (k, c) in enumerate(
        [(2, "登录失败了怎么办"), (1, "重启试下"), (1, "换个网络"), (1, "清下缓存")])]
    df = spark.createDataFrame(rows, "session_id string, msg_id bigint, sender_type int, content string, created_at timestamp, file_url string, sensitive_word string")
    got = fq.extract_faq(ms.clean_messages(df)).collect()[0]
    assert got.answer == "换个网络\n\n清下缓存" and got.category_id == "network-access"


def test_answer_parts_keep_everything(chats):
    strong = fq.strong_answers(ms.clean_messages(chats))
    parts = {(r.session_id, r.part): r.answer for r in fq.answer_parts(strong, 1).collect()}
    assert parts[("s1", 0)].startswith("请先登录") and parts[("s1", 1)].startswith("请提供作业号")


def test_session_text_is_cut_after_joining(chats):
    full = {r.session_id: r for r in ms.session_text(ms.clean_messages(chats)).collect()}
    cut = {r.session_id: r for r in ms.session_text(ms.clean_messages(chats), 30, 10).collect()}
    assert full["s1"].text.split("\n")[0] == "访客: 请问高斯16如何安装在集群上？"
    assert cut["s1"].text == full["s1"].text[:30] and cut["s1"].preview == full["s1"].text[:10]


def test_column_aliases(spark, tmp_path):
    raw = spark.createDataFrame([("a", 2, "hi", "2024-01-01")], ["mainUniqueId", "消息发送方类型(1客服)", "content", "createTime"])
    out = normalize_chat_columns(raw)
    assert out.select("session_id", "sender_type", "content").collect()[0] == ("a", 2, "hi")
    with pytest.raises(ValueError):
        normalize_chat_columns(raw.drop("content"))
    path = str(tmp_path / "chat.json")
    raw.write.json(path)
    assert read_chat_messages(spark, path, "json").count() == 1


def test_session_document_round_trip(spark):
    doc = ("---\nsource_type: chat\nsession_id: \"abc123\"\nmessage_count: 3\n---\n\n# 会话 abc123\n\n## 对话记录\n- [2024-01-01 10:00:00] **访客**: 怎么安装: 高斯\n"
           "- [2024-01-01 10:01:00] **客服**: 点击安装\n闲话\n\n## 链接与附件内容\n\n### [网页] a\n\n来源: https://a.cn\n\n正文\n")
    files = spark.createDataFrame([("file:/x/session_zzz.md", doc)], "file_path string, text string")
    got = parse_session_docs(files).collect()[0]
    assert got.session_id == "abc123" and got.meta["message_count"] == "3"
    assert [(m.role, m.content) for m in got.transcript] == [("访客", "怎么安装: 高斯"), ("客服", "点击安装")]
    assert got.link_section.startswith("### [网页] a")
    assert session_messages(parse_session_docs(files)).filter(F.col("role") == rules.AGENT).count() == 1


def test_skip_rules(chats):
    rows = {r.session_id: r for r in ms.skip_sessions(ms.clean_messages(chats)).collect()}
    assert rows["s2"].skip and not rows["s1"].skip


def test_link_blocks(spark):
    section = ("### [网页] 教程页\n\n来源: https://a.cn/x\n\n_fetched_at: 2024\n第一步点击控制台右上角的开通按钮，并等待页面刷新出现结果\n然后等待平台处理完成即可使用\n\n"
               "### [图片 OCR] https://b.cn/1.png\n\n短\n")
    df = spark.createDataFrame([(section,)], "s string").select(fq.parse_link_blocks(F.col("s")).alias("b"))
    blocks = df.collect()[0].b
    assert [(b.url, b.title, b.kind) for b in blocks] == [("https://a.cn/x", "教程页", "网页")]
    assert blocks[0].body == "第一步点击控制台右上角的开通按钮，并等待页面刷新出现结果\n然后等待平台处理完成即可使用"
    got = df.select(fq.steps_from_blocks(F.col("b")).alias("s"), fq.synthesize_answer(F.lit("https://a.cn/x"), F.col("b")).alias("a")).collect()[0]
    assert got.s == ["第一步点击控制台右上角的开通按钮，并等待页面刷新出现结果"]
    assert "参考：https://a.cn/x" in got.a
