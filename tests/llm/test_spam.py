import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from shiori.llm import spam

RNG = random.Random(8)
NOUNS = ["pump", "valve", "drill", "sensor", "台座", "歯車", "配管", "工具"]
SPAM = ["cheap", "sale", "online", "通販", "激安", "人気"]
PROSE = ["The report was checked by the team before it was sent to the office.", "After the meeting nobody knew who had to pay for the repair.", "会議では来月の予定を確認し、担当を決めることになった。", "詳しい手順は、後で送る資料を見てください。", "Der Bericht wurde geprüft und an die Zentrale geschickt."]


def prose():
    return "\n".join(" ".join(RNG.choice(PROSE) for _ in range(RNG.randrange(1, 4))) for _ in range(RNG.randrange(2, 8)))


def junk():
    word = lambda: f"{RNG.choice(NOUNS)} {RNG.choice(SPAM)}"
    kind = RNG.randrange(5)
    n = RNG.randrange(6, 30)
    if kind == 0:
        return "\n".join(f"{word()} https://x{RNG.randrange(9)}.example/p/{RNG.randrange(999)}" for _ in range(n))
    if kind == 1:
        return "".join(f"#{word().replace(' ', '')}" for _ in range(n))
    if kind == 2:
        return " | ".join(RNG.choice(["Home", "Cart", "Login", "ホーム", word()]) for _ in range(n))
    if kind == 3:
        return ", ".join(word() for _ in range(n))
    return "\n".join(f"QX-{RNG.randrange(100, 999)}" for _ in range(n))


def record():
    return "\n".join(f"{k}: {RNG.randrange(500)}" for _ in range(6) for k in ("数量", "単価", "note"))


def test_held_out_pages():
    train = [(prose(), int(RNG.random() < 0.04)) for _ in range(60)] + [(junk(), int(RNG.random() > 0.04)) for _ in range(25)] + [(record(), 0) for _ in range(10)]
    pages = [(prose(), 0) for _ in range(150)] + [(junk(), 1) for _ in range(100)] + [(record(), 0) for _ in range(30)] + [("品質記録 v2", 0), ("Overview", 0)] + [(prose() + "\n" + junk() * 9, 1) for _ in range(30)]
    for model in (spam.fit(train), spam.fit([])):
        lists, every = spam.list_share([t for t, _ in pages], model)
        right = [(a > 0.5 * b) == bool(y) for a, b, (_, y) in zip(lists, every, pages)]
        assert np.mean(right) >= 0.95


def slow_decode(model, seen):
    score = model.scores(seen)
    best, back = model.start + score[0], []
    for s in score[1:]:
        ways = best[:, None] + model.move
        back.append(ways.argmax(axis=0))
        best = ways.max(axis=0) + s
    state = [int(best.argmax())]
    for b in reversed(back):
        state.append(int(b[state[-1]]))
    return state[::-1]


def test_decoding_all_texts_together():
    texts = [prose(), junk(), "", "一行", record(), junk() + "\n" + prose()]
    model = spam.fit([])
    text, seen, width = spam.observe(texts)
    together = model.decode(text, seen)
    for k in range(len(texts)):
        alone_text, alone_seen, _ = spam.observe([texts[k]])
        assert (alone_seen == seen[text == k]).all()
        if len(alone_seen):
            assert slow_decode(model, alone_seen) == together[text == k].tolist()
    assert width.sum() == sum(len("".join(t.split())) for t in texts)


def test_odd_texts():
    model = spam.fit([("", 1), ("\n\n", 0)])
    texts = [None, "", "\n", " 　", "。", "!!!", "a" * 100_000, "𠮷👷" * 50, "\ud800x", "http://", "x. y. z. " * 5_000]
    lists, every = spam.list_share(texts, model)
    assert (lists <= every).all() and every[:4].tolist() == [0, 0, 0, 0]


def test_flags(spark):
    rows = [(1, prose()), (2, junk() * 3), (2, junk() * 3), (3, None), (4, ""), (None, junk()), (5, "制御盤 v3"), (6, "\n".join(prose() for _ in range(400)))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("is_spam", F.lit("clash"))
    labels = spark.createDataFrame([(1, 0), (2, 1), (2, None), (9, 1), (None, 1)], "doc_id long, is_spam int")
    got = {r["doc_id"]: r["is_spam"] for r in spam.flag_spam(docs, labels).collect()}
    assert got == {1: False, 2: True, 3: False, 4: False, 5: False, 6: False}
    assert spam.flag_spam(docs, labels.limit(0)).where("is_spam").count() == 1
    assert spam.flag_spam(docs.limit(0), labels).count() == 0


@pytest.mark.parametrize("line, state", [("The results were checked by the team at the end of the day.", "prose"), ("Home | Cart | Login | About | Sitemap", "menu"), ("cheap bolts https://a.example/x/1", "link"), ("数量: 12", "record")])
def test_states_of_lines(line, state):
    model = spam.fit([])
    text, seen, _ = spam.observe(["\n".join([line] * 5)])
    assert {spam.STATES[k] for k in model.decode(text, seen)} == {state}


# Pages of languages whose grammar the model doesn't know, code, and keywords dressed as sentences or in other languages.
UNSEEN = [
    (False, '我们昨天开会讨论了这个项目的进展。大家都同意在下个月之前完成测试。'),
    (False, '这台机器的温度太高了，请马上联系维修人员。'),
    (False, '어제 회의에서 다음 달 일정을 정했습니다. 담당자는 내일까지 보고서를 제출해야 합니다.'),
    (False, '기계의 온도가 너무 높아서 작업을 멈추었다.'),
    (False, 'Wczoraj na spotkaniu omówiliśmy postęp prac i ustaliliśmy nowe terminy. Raport zostanie wysłany do klienta w piątek.'),
    (False, 'Maszyna nie działa, ponieważ czujnik jest uszkodzony.'),
    (False, 'ناقش الفريق أمس خطة العمل للشهر القادم. سيتم إرسال التقرير إلى العميل يوم الجمعة.'),
    (False, 'कल की बैठक में हमने अगले महीने की योजना पर चर्चा की। रिपोर्ट शुक्रवार को भेजी जाएगी।'),
    (False, 'Вчера на совещании мы обсудили план работ на следующий месяц. Отчет будет отправлен в пятницу.'),
    (False, 'Ayer hablamos de los plazos del proyecto y decidimos cambiar la fecha de entrega. El informe se enviará el viernes.'),
    (False, 'Ieri abbiamo discusso il piano di lavoro con il cliente. La relazione sarà pronta per venerdì.'),
    (False, 'Vi diskuterade planen för nästa månad och bestämde att rapporten ska skickas på fredag.'),
    (False, 'Dün toplantıda projenin ilerlemesini konuştuk. Rapor cuma günü müşteriye gönderilecek.'),
    (False, 'Chúng tôi đã thảo luận kế hoạch cho tháng sau và quyết định gửi báo cáo vào thứ sáu.'),
    (False, 'เมื่อวานนี้เราได้ประชุมเรื่องแผนงานของเดือนหน้า และตกลงว่าจะส่งรายงานในวันศุกร์'),
    (False, 'Χθες συζητήσαμε το σχέδιο για τον επόμενο μήνα. Η αναφορά θα σταλεί την Παρασκευή.'),
    (False, "import os\n\ndef load(path):\n    with open(path) as f:\n        return f.read()\n\nfor name in os.listdir('.'):\n    print(name, len(load(name)))\n"),
    (False, '#include <stdio.h>\nint main(void) {\n  int total = 0;\n  for (int i = 0; i < 10; i++) {\n    total += i;\n  }\n  printf("%d\\n", total);\n  return 0;\n}\n'),
    (False, '発注済み。納期は来週。部品待ち。\n山田さんに確認、返事なし。\n明日また電話する。'),
    (True, 'If you need shoes then buy shoes because our shoes are the cheapest shoes and the best shoes for men shoes and women shoes in the shoes store with shoes discount.'),
    (True, 'cheap bolts, buy bolts online, bolts sale, best bolts, bolts repair, bolts discount, bolts near me, bolts price'),
    (True, 'Home | Products | About | Contact | Login\nHome > Shop > Sale > Cart\nSitemap | Privacy | Terms | Help'),
    (True, 'tanie śruby, śruby sklep, śruby online, śruby wyprzedaż, najlepsze śruby, śruby promocja, śruby cena, śruby hurt'),
    (True, 'дешевые болты, купить болты, болты онлайн, болты скидка, болты цена, лучшие болты, болты оптом'),
    (True, 'ボルト 通販 ボルト 激安 ボルト 人気 ボルト 最安値 ボルト 送料無料 ボルト おすすめ'),
    (True, 'https://shop.example/a/1\nhttps://shop.example/a/2\nhttps://shop.example/a/3 cheap\n'),
]


@pytest.mark.parametrize("fitted", [False, True])
def test_other_languages_code_and_dressed_keywords(fitted):
    train = [(prose(), 0) for _ in range(60)] + [(junk(), 1) for _ in range(25)] + [(record(), 0) for _ in range(10)]
    lists, every = spam.list_share([t for _, t in UNSEEN], spam.fit(train if fitted else []))
    wrong = [t[:20] for a, b, (want, t) in zip(lists, every, UNSEEN) if (a > 0.5 * b) != want]
    assert len(wrong) <= 1, wrong
