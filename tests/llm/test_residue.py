import random

import pytest
from pyspark.sql import functions as F

from brinewell.llm import residue as r

BAD = [
    "尊敬的{姓名}同学,您的编号是{编号}。",
    "Dear {first_name}, your slot is {{slot}} in {{ room }}.",
    "截止日期为XXXX年XX月XX日,联系人${contactName}",
    "主讲人:XXX,职称:XXX,单位:XXXX大学",
    "<%= content_for :lead %>",
    "Posted by %AUTHOR% on %DATE%",
    "#标题# #副标题# #作者#",
    "[[摘要]] 待补充",
    "Total: NaN, owner: [object Object]",
    "占位文本占位文本占位文本占位文本占位文本。",
    "asdf asdf jkl jkl asdf asdf jkl jkl 321",
    "aaa bbb ccc aaa bbb ccc 114",
    "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu " * 4,
    "甲乙丙丁戊己庚辛壬癸子丑寅" * 4,
    "测试测试测试",
    "Lorem ipsum dolor sit amet",
    "Durent lacumen dolorum ipsuli fasti mirabo carpent gravo helmet velara.",
]
MESSAGES = [
    "您访问的页面不存在或已被删除。",
    "502 Bad Gateway: the upstream host closed the connection.",
    "You need to enable JavaScript to run this app.",
    "您的浏览器未开启脚本功能,本页面需要启用JavaScript后才能正常显示,请修改设置后刷新。",
    "Warning: undefined variable $row in /srv/app/view_4533.php on line 4533",
]
ORDINARY = [
    "图书馆将于周六进行系统升级维护，届时暂停服务。",
    "大家在微博发布#校庆#照片，欢迎转发。",
    "The standard says that 0/0 yields NaN in every format.",
    "Let {x} be a bounded sequence of reals.",
    "He was told Access denied at the gate and went home.",
]
GOOD = [
    *ORDINARY,
    "讲义第10页用花括号 {{ name }} 表示待替换的字段，宿管老师要求毕业生抄写11遍。",
    "Chapter 16 shows a template such as {{ title }} and asks two doctoral students to fill it in by hand.",
    "设集合 {x | x > 90} 与 {y | y < 885}，试说明轻量样本标注的历史背景。",
    "The workshop on error pages at the Quarry Hall compared 21 ways to word a 404 message.",
    "In the JavaScript module, a visiting lecturer illustrated 49 small programs about a layered pore analysis.",
    "设备管理员在JavaScript入门课上解释了为什么浏览器禁用脚本后工具箱页面仍能阅读。",
    "古籍修复学院的外聘导师在报告里分析了“500错误”与“503错误”出现4049次的原因。",
    "公共植被恢复实训在槐荫会议室404室进行，请毕业生提前40分钟到场。",
    "Terms of use · Data protection · Cookies",
    "本站使用Cookie以改善浏览体验,继续访问即表示同意。",
    "Café staff served Äpfel, jalapeño and crème brûlée to 12 guests – a retired examiner paid.",
    "",
    "。。。。。。。。。。。。",
    "----------------",
]


@pytest.mark.parametrize("text", BAD)
def test_residue_is_seen(text):
    assert r.residue_sentences("一段正常的文字。\n" + text)


@pytest.mark.parametrize("text", MESSAGES)
def test_messages_are_seen(text):
    assert any(m for _, m in r.messages(text))


def test_ordinary_sentences_are_clean_as_whole_bodies(spark):
    rows = [(i, None, f"https://h{i}.example/p/{i}", "Harvest of the valley", t, None) for i, t in enumerate(ORDINARY)]
    assert r.find_residue(table(spark, rows)).collect() == []


def test_messages_count_alone_or_recurring(spark):
    rows = [(0, None, "https://h1.example/a", "Harvest of the valley", "Internal Server Error. Error code 77.", None)]
    rows += [(i, None, "https://h1.example/a", t, "Access denied to the object that you asked for, code 12.", None) for i, t in ((1, "River survey"), (2, "Quarry opens"))]
    rows += [(3, None, "https://h1.example/a", "River survey", "The river survey opens in May. Access denied to the object that you asked for, code 12.", None)]
    assert {tuple(x) for x in r.find_residue(table(spark, rows)).collect()} == {(0, "content"), (1, "content"), (2, "content")}


def test_long_answers_are_found(spark):
    pick = random.Random(9)
    word = lambda: "".join(pick.choices("bcdfghklmnprstvaeiou", k=6))
    answer = ". ".join("Please " + " ".join(word() for _ in range(12)) for _ in range(12)) + "."
    rows = [(i, None, f"https://h{i % 4}.example/p/{i}", f"Report {word()} {word()}", f"{answer} Ticket {i}.", None) for i in range(10)]
    rows += [(20 + i, None, f"https://h{i % 4}.example/p/{i}", f"Report {word()} {word()}", " the ".join(word() for _ in range(150)), None) for i in range(4)]
    assert len(answer) > 800 and {tuple(x) for x in r.find_residue(table(spark, rows)).collect()} == {(i, "content") for i in range(10)}


@pytest.mark.parametrize("text", GOOD)
def test_texts_about_it_are_none(text):
    assert r.residue_sentences(text) == []


@pytest.mark.parametrize("title", ["无标题文档", "新建网页 1", "404 Not Found", "undefined", "{{ page.title }}", "Oops!", "Template_{0}_{1}", "请输入标题", "此处为文章标题(示例)"])
def test_default_titles(title):
    assert r.residue_title(title)


@pytest.mark.parametrize("title", ["关于基层传感网络第19期工作的通知", "Heron Workshop timetable, notice 404", "错误页面设计讲座", "Untitled works of the archive"])
def test_ordinary_titles(title):
    assert not r.residue_title(title)


def table(spark, rows):
    cols = "item_id long, url string, normalized_url string, title string, content string, raw_html string"
    return spark.createDataFrame(rows, cols).withColumn("host", F.lit("clash")).withColumn("name", F.lit(1))


def test_found_by_host_evidence(spark):
    rows = []
    for i in range(12):  # a message that no pattern knows, under unlike titles
        rows.append((i, None, f"https://h{i % 4}.example/p/{i}", f"Harvest report of valley {chr(97 + i) * 4}", f"Please come back later, ticket {i}.", None))
    for i in range(20, 24):  # the site's own name in place of a title
        rows.append((i, None, f"https://h9.example/p/{i}", "Valley Portal" if i == 20 else f"Story {i}", f"Text number {i} of the valley story", f"<html><head><title>Story {i} - Valley Portal</title></head></html>"))
    rows += [(50, None, None, None, None, None), (51, None, "https://h1.example/", "", "", ""), (0, *rows[0][1:])]
    got = {tuple(x) for x in r.find_residue(table(spark, rows), site_names=True).collect()}
    assert got == {(i, "content") for i in range(12)} | {(20, "title")}
    assert {tuple(x) for x in r.find_residue(table(spark, rows)).collect()} == {(i, "content") for i in range(12)}


def test_cleaned(spark):
    rows = [(1, "u", "u", "无标题文档", "A fine text about rivers.", None), (2, "u", "u", "Rivers", "<%= lead %>", None), (3, "u", "u", None, None, None)]
    df = table(spark, rows)
    out = {x["item_id"]: (x["title"], x["content"], x["host"]) for x in r.without_residue(df).collect()}
    assert out == {1: (None, "A fine text about rivers.", "clash"), 2: ("Rivers", None, "clash"), 3: (None, None, "clash")}
    assert r.find_residue(df.where("false")).collect() == []


def test_html_titles_are_read_wherever_they_stand(spark):
    head = "<html><head><style>" + "p { margin: 0 }\n" * 200 + "</style>"
    rows = [(i, None, f"https://h9.example/p/{i}", "Valley Portal" if i == 20 else f"Story {i}", f"Text number {i} of the valley story", f"{head}<title>Story {i} - Valley Portal</title></head></html>") for i in range(20, 24)]
    rows.append((30, None, "https://h8.example/", "Mill Pages", "A text about the mill", f"{head}<title>Mill Pages - Mill Pages</title></head></html>"))
    assert {tuple(x) for x in r.find_residue(table(spark, rows), site_names=True).collect()} == {(20, "title"), (30, "title")}


def test_shared_titles_need_unlike_bodies_without_their_terms(spark):
    pick = random.Random(7)
    words = ["".join(pick.choices("bcdfghklmnprstvaeiou", k=7)) for _ in range(2000)]
    text = lambda: "the " + " ".join(pick.choices(words, k=90)) + "."
    one = text()
    rows = [(i, None, f"https://h{i % 3}.example/p/{i}", "River survey opens", f"{one} Edited copy {chr(97 + i) * 9}.", None) for i in range(10)]  # copies
    rows += [(i, None, f"https://h{i % 3}.example/p/{i}", "Quarry opens", f"The quarry opens. {text()}", None) for i in range(20, 32)]  # a real title that recurs
    rows += [(i, None, f"https://h{i % 3}.example/p/{i}", "Welcome page", text(), None) for i in range(40, 52)]
    frame = table(spark, rows)
    assert {tuple(x) for x in r.find_residue(frame).collect()} == {(i, "title") for i in range(40, 52)}
    assert r.find_residue(frame, title_share=0.5).collect() == []  # too few for hosts of so many pages
