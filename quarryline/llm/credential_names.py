"""How much a name speaks of a credential: a logistic regression over the character n-grams of identifiers.

The model is fitted on names put together from word lists with a seed, so that spellings, abbreviations and compounds
that no list holds are read by their letters. It gives one number per name, which the line model takes as a feature and
the choice of lines to read as one of its reasons.
"""

from __future__ import annotations

import random
import re

import numpy as np

#: Words for a credential in the languages that code is written in, with usual abbreviations.
SECRET = (
    "password passwd passphrase passcode passwort kennwort pwd psw pswd pw pass secret token apikey auth credential credentials authorization bearer "
    "motdepasse mdp contrasena contrasenia senha parola wachtwoord haslo salasana losenord heslo sifre parol pgpass userpass dbpass smtppass dbpw userpw rootpw privkey secretkey accesskey apisecret authkey sastoken"
).split()
#: What stands before 'key' in the name of a credential.
KEYED = "api access secret private signing encryption client auth master account license service session storage deploy shared webhook consumer".split()
#: Words of the same letters, or about credentials, that name none.
OTHER = (
    "compass bypass passenger passage passed passing passive tokens tokenizer tokenize tokencount secretary secretion author authors authority authored authored_by keyword keywords keyboard keys keyframe monkey "
    "hotkey primarykey foreignkey sortkey cachekey partitionkey rowkey mapkey passthrough pathway pager power powder pwm mdpi clavicle parole parolee hash digest checksum sha256 md5 etag commit revision integrity id uuid "
    "name type kind path url uri host port user email count total limit size length width height index label title text value values data item items list row rows column state status mode level color style class function "
    "module import export default const return result response request query filter sort order group page file folder image video audio date time day month year version build release branch source target config option options param params arg args"
).split()
#: Ends of names of settings about credentials.
ABOUT = "length type header url uri name path ttl kind expiry expires limit count field policy hint min max digest hash id label required enabled endpoint prefix rotation age days size rule rules format error message".split()

_WORD = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+")


def words_of(name: str) -> tuple[str, str]:
    """The last word of a name and the one before it, in lower case; digits at the end are no word."""
    words = _WORD.findall(name)
    while words and words[-1].isdigit():
        words.pop()
    return (words[-1].lower() if words else "", words[-2].lower() if len(words) > 1 else "")


def parts(word: str, mark: str) -> set[str]:
    """n-grams of a word, marked by its place in the name."""
    w = "^" + word[-24:] + "$"
    return {mark + w[i : i + n] for n in (2, 3, 4, 5) for i in range(len(w) - n + 1)} | {mark + w}


def training_names(seed: int = 5) -> list[tuple[str, bool]]:
    """Names with whether they are a credential's."""
    r = random.Random(seed)
    plain = "db user admin root smtp mail redis mongo cache stripe github slack aws azure app web prod test main old new backup ftp ssh ldap jwt oauth my".split()
    out = []
    for words, yes in (([[s] for s in SECRET] + [[k, "key"] for k in KEYED] + [["key"]], True), ([[w] for w in OTHER] + [[s, a] for s in SECRET for a in ABOUT] + [[k, "key", a] for k in KEYED for a in ABOUT], False)):
        for w in words:
            for _ in range(14 if yes else 2):
                full = [*(r.choice(plain) for _ in range(r.choice([0, 0, 1, 2]))), *w]
                style = r.randrange(4)
                name = "_".join(full) if style == 0 else "_".join(full).upper() if style == 1 else full[0] + "".join(x.title() for x in full[1:]) if style == 2 else "".join(full)
                out.append((name + (f"_{r.randrange(999)}" if r.random() < 0.2 else ""), yes))
    return out


def fit(rounds: int = 80, penalty: float = 1e-3) -> dict[str, float]:
    """Weight of each n-gram; '' is the constant."""
    names = training_names()
    index: dict[str, int] = {"": 0}
    rows, cols = [], []
    for k, (name, _) in enumerate(names):
        for p in ["", *sorted(parts(words_of(name)[0], "<") | parts(words_of(name)[1], ">"))]:
            rows.append(k), cols.append(index.setdefault(p, len(index)))
    rows, cols, want = np.array(rows), np.array(cols), np.array([y for _, y in names], float)
    w, m1, m2 = (np.zeros(len(index)) for _ in range(3))
    for it in range(1, rounds + 1):
        p = 1 / (1 + np.exp(-np.bincount(rows, w[cols], len(names))))
        g = np.bincount(cols, (want - p)[rows], len(index)) / len(names) - penalty * w / 10
        m1, m2 = 0.9 * m1 + 0.1 * g, 0.98 * m2 + 0.02 * g * g
        w += 0.2 * (m1 / (1 - 0.9**it)) / (np.sqrt(m2 / (1 - 0.98**it)) + 1e-7)
    return {n: round(float(w[i]), 4) for n, i in index.items() if abs(w[i]) > 0.01 or not n}


class Names:
    """Levels of names by the weights of fit(): 0 to 3, 3 being a credential's for sure. Words are scored once each."""

    def __init__(self, weights: dict[str, float]):
        self.weights, self.known, self.names = weights, ({}, {}), {}

    def _score(self, word: str, place: int) -> float:
        got = self.known[place].get(word)
        if got is None:
            if len(self.known[place]) > 200_000:
                self.known[place].clear()
            got = self.known[place][word] = sum(self.weights.get(p, 0.0) for p in parts(word, "<>"[place]))
        return got

    def level(self, name: str) -> int:
        got = self.names.get(name)
        if got is None:
            if len(self.names) > 200_000:
                self.names.clear()
            last, before = words_of(name)
            score = self.weights[""] + self._score(last, 0) + self._score(before, 1)
            if len(last) < 3 and last not in SECRET:
                score = -9.0  # too short to say anything by its letters
            got = self.names[name] = 0 if score < -2 else 1 if score < 0 else 2 if score < 2 else 3
        return got
