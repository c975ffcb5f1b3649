"""A plain replay of typing sessions, for key strokes alone (one window, no shortcuts, clicks or settings).

Written from the rules, with everything worked out anew at each key: words are lists of keys, the sentence is a list of
words, lookups go to sets. It shares no code with the machine.
"""

LETTERS = set("abcdefghijklmnopqrstuvwxyz")


class Book:
    def __init__(self, rows, priors):
        """rows: (lang, form, tier names that hold)."""
        self.tiers = {}
        for lang, form, names in rows:
            for n in names:
                self.tiers.setdefault((lang, n), set()).add(form)
        self.priors = priors

    def has(self, lang, tier, form):
        return form in self.tiers.get((lang, tier), ())

    def known(self, lang, form):
        if len(form) <= 2:
            return self.has(lang, "is_short", form)
        return self.has(lang, "is_word", form) or self.has(lang, "is_common", form)

    def facts(self, keys):
        en = "".join(k[0] for k in keys)
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in en)
        fa = "".join(k[1] for k in keys)
        bits = low.split("'")
        shaped = len(bits) <= 2 and all(b and set(b) <= LETTERS for b in bits)
        en_known = shaped and self.known(1, low)
        fa_known = self.known(2, fa) or (fa.startswith("ا") and self.known(2, "آ" + fa[1:]))
        return {
            "text": {1: en, 2: fa}, "form": {1: low, 2: fa}, "known": {1: en_known, 2: fa_known}, "n": len(keys),
            "frequent": {1: en_known and self.has(1, "is_frequent", low), 2: fa_known and self.has(2, "is_frequent", fa)}, "prior": self.priors.get(low, 0),
        }


def decide(book, keys, active, context, strength, start, phase):
    """('none' | 'wait' | 'now', confidence) at balanced sensitivity, for phases live, idle and end."""
    n = len(keys)
    if n < 2 or n > 32:
        return "none", 0
    f, other = book.facts(keys), 3 - active
    if not f["known"][other]:
        return "none", 0
    clash = f["known"][active]
    if clash:
        points = 0
        if context == other:
            points += 30 * strength
        if context == active:
            points -= 30 * strength
        if f["frequent"][other] and not f["frequent"][active]:
            points += 45
        if f["frequent"][active] and not f["frequent"][other]:
            points -= 45
        prior = f["prior"] if other == 2 else -f["prior"]
        points += prior if start and n >= 3 else int(prior / 4)
        points += {"live": 0, "idle": 5, "end": 10}[phase]
        if points < 35:
            return ("wait" if phase == "live" and points >= 30 else "none"), 0
        confidence = min(100, points)
    else:
        confidence = 100 if n >= 5 else 95 if n >= 3 else 90
    if phase == "end":
        return "now", confidence
    if n == 2:
        return ("wait" if phase == "live" else "now"), confidence
    if phase == "live":
        if clash and context == other and strength >= 4:
            return "now", confidence
        return ("wait" if book.has(active, "is_prefix", f["form"][active]) else "now"), confidence
    return ("wait" if not clash and book.has(active, "is_common_prefix", f["form"][active]) else "now"), confidence


def decide_words(book, words, context, strength):
    total, known = {1: 0, 2: 0}, {1: 0, 2: 0}
    for keys in words:
        f = book.facts(keys)
        for lang in (1, 2):
            if f["known"][lang]:
                total[lang] += 48 if f["frequent"][lang] else 30
                known[lang] += 1
            else:
                total[lang] -= 16 if f["n"] <= 2 else 26
    for lang in (1, 2):
        if known[lang] == len(words):
            total[lang] += 12 + 8 * len(words)
        if context == lang and 1 <= strength <= 4:
            total[lang] += 8 * strength
    for lang in (1, 2):
        lead = total[lang] - total[3 - lang]
        if lead >= 40 and known[lang] == len(words):
            return lang, min(100, lead)
    return 0, 0


def replay(book, events, until=1_500):
    """(edits, counters) of one session; events: (ts, vk, shift, layout language, english, persian)."""
    edits, seen, checked, corrected = [], 0, 0, 0
    word, extra, begun, waiting = [], 0, False, None  # begun: the sentence has a word
    past, off, held = [], False, None  # past: [keys, shown language]
    ctx, power, ctx_at = 0, 0, None
    pace, last = 150, None
    tracked = False

    def observe(language, e, now):
        nonlocal ctx, power, ctx_at
        if ctx == 0 or power <= 0:
            ctx, power = language, e
        elif ctx == language:
            power = e if power < e else min(4, power + 1)
        elif power > e:
            power -= e
        elif power == e:
            ctx, power = 0, 0
        else:
            ctx, power = language, e - power
        ctx_at = now

    def intent(now):
        nonlocal ctx, power, ctx_at
        if ctx_at is None or now - ctx_at > 90_000:
            ctx, power, ctx_at = 0, 0, None
        return (ctx, power) if power > 0 else (0, 0)

    def push(keys, language):
        nonlocal past, off
        if off:
            return
        size = sum(len(k) for k, _ in past) + max(0, len(past) - 1)
        if len(past) >= 31 or size + len(keys) + (1 if past else 0) > 479:
            past, off = [], True
        else:
            past.append([list(keys), language])

    def text(keys, language):
        return book.facts(keys)["text"][language]

    def swap(now, language, confidence, deleted, delimiter):
        nonlocal corrected, begun
        edits.append((now, "word", text(word, language), text(word, 3 - language), deleted, delimiter, language, 3 - language, confidence))
        corrected += 1
        begun = True
        observe(3 - language, 3, now)

    active = None
    for ts, vk, shift, language, english, persian in [*events, (None, "", False, 0, None, None)]:
        now = events[-1][0] + until if ts is None else ts
        if waiting is not None and now >= waiting:
            at, waiting = waiting, None
            if tracked and not extra and len(word) >= 2:
                c = intent(at)
                checked += 1
                what, confidence = decide(book, word, active, *c, not begun, "idle")
                if what == "now":
                    swap(at, active, confidence, len(word), "")
                    held = [list(word), 3 - active]
                    word, extra, tracked, last = [], 0, False, None
        if ts is None:
            break
        active = language
        if english:
            if held is not None:
                past, off, held = [], False, None
            waiting = None
            seen += 1
            tracked = True
            if len(word) < 32 and not extra:
                word.append((english, persian))
            else:
                extra += 1
            if last is not None:
                usable = pace if 40 <= pace <= 500 else 150
                pace = (3 * usable + ts - last) // 4 if 20 <= ts - last <= 1_500 else usable
            last = ts
            if extra:
                continue
            what, confidence = decide(book, word, language, *intent(ts), not begun, "live")
            if what == "now":
                swap(ts, language, confidence, len(word) - 1, "")
                held = [list(word), 3 - language]
                word, extra, tracked, last = [], 0, False, None
            elif what == "wait":
                waiting = ts + max(450, min(900, 3 * max(40, min(500, pace))))
            continue
        period = vk == "Period" and not shift
        ends = vk == "Return" or period or (shift and vk in ("1", "Slash"))
        waiting = None
        if vk in ("Space", "Return", "Tab") or period:
            checked += 1
            if not word and not extra and held is not None:
                keys, shown = held
                held = None
                if vk == "Space":
                    push(keys, shown)
                    begun, tracked, last = True, False, None
                    continue
                past, off = [], False
            c = intent(ts)
            done = False
            if word and not extra and vk == "Space":
                for first in range(len(past)):
                    run = [k for k, _ in past[first:]] + [word]
                    lang, confidence = decide_words(book, run, *c)
                    if not lang:
                        continue
                    shown = [s for _, s in past[first:]] + [language]
                    before, after = (" ".join(text(k, s) for k, s in zip(run, langs)) for langs in (shown, [lang] * len(run)))
                    if any(s != lang for s in shown) and max(len(before), len(after)) <= 512:
                        edits.append((ts, "phrase", before, after, len(before), "Space", language, lang, confidence))
                        for p in past[first:]:
                            p[1] = lang
                        push(word, lang)
                        begun = True
                        observe(lang, 4, ts)
                        corrected += 1
                        done = True
                    break
            if not done and not extra:
                what, confidence = decide(book, word, language, *c, not begun, "end")
                if what == "now":
                    swap(ts, language, confidence, len(word), vk)
                    if vk == "Space":
                        push(word, 3 - language)
                    else:
                        past, off, held = [], False, None
                    done = True
                elif word and book.facts(word)["known"][language]:
                    f = book.facts(word)
                    observe(language, 1 if f["known"][3 - language] else 3 if f["frequent"][language] else 2, ts)
            if not done:
                if word and not extra and vk == "Space":
                    push(word, language)
                else:
                    past, off, held = [], False, None
                if word or extra:
                    begun = True
        else:
            past, off, held = [], False, None
        if ends:
            begun = False
            past, off, held = [], False, None
        word, extra, tracked, last = [], 0, False, None
    return edits, (seen, checked, corrected)
