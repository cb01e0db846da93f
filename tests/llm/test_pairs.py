import pytest

from tracelake.llm import pairs as P

ZH = "按照甲方与乙方签订的《设备采购合同》（CG-12-345），逾期交付超过30日时违约金怎么计算？"
EN = "Under the lease CG-12-345, until when does the 4,000 bond run? Please name the clause."


@pytest.mark.parametrize(
    ("answer", "question", "want"),
    [
        (None, ZH, "empty"), ("", ZH, "empty"), ("​ 　", ZH, "empty"), ("```\n```", ZH, "empty"), ("<p> </p>", ZH, "empty"), ("[]", ZH, "empty"), ("N/A", EN, "empty"), ("（空）", ZH, "empty"), ("&nbsp;", EN, "empty"),
        ("7%", ZH, None), ("Yes.", EN, None), ("可以。", ZH, None), ("2025年3月7日", ZH, None), ("45 working days", EN, None), ("甲乙食品供应站", ZH, None), ("Bortick Freight Partners", EN, None), ("41,160 credits", EN, None),
        ("抱歉，我无法回答关于码头的这个问题，请换个问法再试。", ZH, "refusal"), ("I'm sorry, but I don't have access to CG-12-345.", EN, "refusal"), ("As an AI assistant, I cannot comment on that. Please ask the project office.", EN, "refusal"),
        ("抱歉让您久等，已核对完毕。违约金按每日3%计算。", ZH, None), ("停工超过9日可以顺延工期，但不能主张窝工费。", ZH, None), ("If the supplier cannot deliver on time, Bortick may end the lease.", EN, None),
        ("我不清楚具体日期。违约金按每日3%计算，最多30日。", ZH, None),
        ("您问的是“" + ZH[:-1] + "”。", ZH, "copied_question"), ("> " + EN, EN, "copied_question"), ('You asked: "' + EN + '"', EN, "copied_question"),
        ("按照《设备采购合同》，逾期交付超过30日时违约金为合同总额的5%，并从保证金中扣除，剩余部分不退还。", ZH, None),
        ("The bond runs for 30 days after the warranty.", ZH, "other_language"), ("保函有效期延续到质保期满后30日。", EN, "other_language"), ("Der Restbetrag ist innerhalb von 30 Tagen zu zahlen.", EN, "other_language"),
        ("The bond runs for 30 days after the warranty.", ZH + "（请用英文作答）", None), ("保函写明“The bond runs for 30 days after the warranty.”为准。", ZH, None),
        ("质保期自验收合格之日起计算，", ZH, "truncated"), ("The bond runs for 30 da", EN, "truncated"), ("1. 违约金为5%。\n2.", ZH, "truncated"), ("```\nbond = 30 days", EN, "truncated"), ("违约金为“合同总额的5%。", ZH, "truncated"), ("The bond runs until...", EN, "truncated"),
        ("违约金为5%。（见CG-12-345第3.3条）", ZH, None), ("The bond runs for 30 days. [CG-12-345, 5.2]", EN, None), ("The answer is stated.", None, None), ("answer", "", "empty"),
    ],
)
def test_defects(answer, question, want):
    assert P.defect(answer, question) == want


def test_stack_of_the_parser():
    assert P.open_at_end("a (b [c") == ["(", "["] and P.open_at_end("a ) b") == [] and P.open_at_end("<b>x") == ["<b"] and P.open_at_end('5" x') == []
    assert P.open_at_end("```py\nx = (\n```") == []


@pytest.mark.parametrize("item", ["deliver the pumps to the yard within nine days of the signing and the rest after the test", "设备应在合同签订后由供货方按约定的批次运至现场或仓库并在验收后移交的备件"])
def test_lists_cut_within_an_item(item):
    whole = f"1. {item}\n2. {item}\n3. "
    assert not P.is_truncated(whole + item) and not P.is_truncated("1. bolts and nuts\n2. steel plates\n3. a pump")
    words = item.split(" ") if " " in item else list(item)
    joint = " " if " " in item else ""
    cuts = [joint.join(words[:n]) for n in range(1, len(words)) if 0.3 <= n / len(words) <= 0.9 and words[n - 1] in {"the", "to", "within", "of", "and", "按", "的", "或"}]
    assert len(cuts) >= 3 and all(P.is_truncated(whole + c) for c in cuts)


def test_repeated_and_short_questions():
    for q in (ZH, EN):
        for answer in (f"{q}\n{q}", f"{q} {q} {q}", f"{q}\n{q[: len(q) // 2]}"):
            assert P.defect(answer, q) == "copied_question"
    assert P.defect("Delivery time?", "Delivery time?") == P.defect("Delivery time?\nDelivery time?", "Delivery time?") == "copied_question"
    assert P.defect("Delivery question?", "Delivery question?") == P.defect("交期？", "交期？") == "copied_question"
    # answers that only name a choice of the question, or say more than it
    assert P.defect("Acme Freight Partners", "Is the deposit paid by Acme Freight Partners or by Bortick?") is None and P.defect("不含税。", "含税还是不含税？") is None
    assert not P.is_copied("Delivery time: 30 days.", "Delivery time?") and not P.is_copied("支払いません", "支払いは？") and not P.is_copied("50", "？")
    assert not P.is_copied(EN + " The bond runs until the end of the warranty under clause 9.", EN)


def test_long_repetition_is_bounded():
    assert P.is_copied(ZH * 400, ZH) and not P.is_copied("甲方" * 20_000, ZH)


def test_tiling():
    assert P.tile_cover(list("abcdefxabc"), list("zabcdefq")) == 6
    assert P.tile_cover(list("aaaa"), list("aa"), 2) == 2 or P.tile_cover(list("aaaa"), list("aa"), 2) == 0


def test_frame(spark):
    rows = [(1, ZH, None, None, "x"), (1, ZH, None, None, "x"), (2, None, "Done.", "", "x"), (3, EN, "y" * 200_000, "可以。", "x")]
    df = spark.createDataFrame(rows, "sample_id long, question string, final_answer string, reference_answer string, key string")
    got = sorted((r.sample_id, r.field_name, r.defect_type) for r in P.defects(df).collect())
    assert got == [(1, "final_answer", "empty"), (1, "final_answer", "empty"), (2, "reference_answer", "empty"), (3, "final_answer", "truncated"), (3, "reference_answer", "other_language")]
    assert P.defects(df.where("1 = 0")).collect() == []


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("I cannot answer this.", True), ("We are not able to share that.", True), ("I'm not sure.", True), ("The documents do not mention a bond.", True), ("No relevant passages were found.", True), ("This question is outside my scope.", True), ("We have no information about it.", True),
        ("目前无法确认。", True), ("我不太清楚。", True), ("系统没有检索到相关内容。", True), ("该问题超出我的能力范围。", True), ("我没法告诉您。", True), ("Ich kann das leider nicht beantworten.", True), ("Je ne sais pas.", True), ("No puedo responder.", True),
        ("The supplier cannot pass on more than 5%.", False), ("Deliveries are not accepted on Sundays.", False), ("供应商不能转包。", False), ("逾期无法交货的，扣除保证金。", False), ("No deposit is due.", False), ("Der Lieferant kann die Preise nicht ändern.", False),
    ],
)
def test_refusal_grammar(text, want):
    assert P.is_refusal(text) is want


def test_forms_of_values():
    for t in ("Harbour & Sons plc", "Müller GmbH", "Port of Example", "东城冷链仓", "3 pallets", "1,200.50 credits", "约5吨", "12 km", "€40 per tonne"):
        assert P.is_value(t), t
    for t in ("The buyer must", "12 within", "Payment is due", "采购方应在", "5日内由", "after 5 days", "Deliver the pumps to"):
        assert not P.is_value(t), t


def test_open_markup_is_seen_at_any_length():
    assert P.open_at_end("<b>" + "x" * 5000)[-1] == "<b" and P.open_at_end("text <a href='" + "y" * 5000)[-1] == "<" and P.open_at_end("a < b, c <d\n" * 3000) == []


def test_no_length_hides_a_copy():
    filler = " and please also see what was said before about this matter in the annex"
    assert P.is_copied(f"{EN} {EN}", EN) and P.is_copied("Q: " + EN + " " + EN + " " + EN, EN) and not P.is_copied(EN + filler * 3, EN)
