"""Word stems stated plainly, letter by letter: the 1980 rules and the extended ones."""

from gradeflow.functions.stems import IRREGULAR, STEP2, STEP2_EXTENDED, STEP2_PLAIN, STEP3, STEP4


def consonant(word, i):
    if word[i] in "aeiou":
        return False
    return word[i] != "y" or i == 0 or not consonant(word, i - 1)


def measure(stem):
    kinds = [consonant(stem, i) for i in range(len(stem))]
    return sum(not a and b for a, b in zip(kinds, kinds[1:]))


def vowel(stem):
    return any(not consonant(stem, i) for i in range(len(stem)))


def cvc(w, extended):
    n = len(w)
    if extended and n == 2 and not consonant(w, 0) and consonant(w, 1):
        return True
    return n >= 3 and consonant(w, n - 3) and not consonant(w, n - 2) and consonant(w, n - 1) and w[-1] not in "wxy"


def longest(word, table):
    return max((x for x in table if word.endswith(x)), key=len, default=None)


def stem(word, extended=True):
    if len(word) <= 3:
        return word
    if extended and word in IRREGULAR:
        return IRREGULAR[word]
    w = word
    if w.endswith("ies"):
        w = w[:-1] if extended and len(w) == 4 else w[:-2]
    elif w.endswith("sses"):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    if extended and w.endswith("ied"):
        w = w[:-1] if len(w) == 4 else w[:-2]
    elif w.endswith("eed"):
        w = w[:-1] if measure(w[:-3]) > 0 else w
    else:
        for suffix in ("ed", "ing"):
            base = w[: -len(suffix)]
            if w.endswith(suffix):
                if vowel(base):
                    w = base
                    if w.endswith(("at", "bl", "iz")):
                        w += "e"
                    elif len(w) > 1 and w[-1] == w[-2] and consonant(w, len(w) - 1):
                        w = w if w[-1] in "lsz" else w[:-1]
                    elif measure(w) == 1 and cvc(w, extended):
                        w += "e"
                break
    if w.endswith("y") and (len(w) > 2 and consonant(w, len(w) - 2) if extended else vowel(w[:-1])):
        w = w[:-1] + "i"
    if extended and w.endswith("alli") and measure(w[:-4]) > 0:
        w = w[:-2]
    two = STEP2 | (STEP2_EXTENDED if extended else STEP2_PLAIN)
    if (x := longest(w, two)) and measure(w[: -len(x)] + ("l" if x == "logi" else "")) > 0:
        w = w[: -len(x)] + two[x]
    if (x := longest(w, STEP3)) and measure(w[: -len(x)]) > 0:
        w = w[: -len(x)] + STEP3[x]
    if (x := longest(w, STEP4)) and measure(w[: -len(x)]) > 1 and (x != "ion" or w[: -len(x)][-1:] in ("s", "t")):
        w = w[: -len(x)]
    if w.endswith("e") and (measure(w[:-1]) > 1 or measure(w[:-1]) == 1 and not cvc(w[:-1], extended)):
        w = w[:-1]
    if w.endswith("ll") and measure(w[:-1]) > 1:
        w = w[:-1]
    return w
