from sparkloom.llm import op3_chat


def test_the_query_formats_short_and_long_conversations_one_way(monkeypatch):
    seen = []
    guess = op3_chat.guessed
    monkeypatch.setattr(op3_chat, "guessed", lambda template, shown, new: seen.append(len(shown)) or guess(template, shown, new))
    for n in (2, 40, 300):
        turns = [("user", f"text {i} <|im_end|>") for i in range(n)]
        seen.clear()
        assert list(op3_chat.render(turns, whole=op3_chat.WHOLE)) == list(op3_chat.render(turns))
        assert seen and seen[0] == 1  # from the second turn on, whatever the length
