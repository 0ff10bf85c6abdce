"""Witness sentences with Universal Dependencies parses (fixed values), as CoNLL-U.

The parses are those of UDPipe 2 (model english-ewt-ud-2.17), licence CC BY-NC-SA; they are data for tests only.
"""

_EMBEDDED = """# text = The proposal, which the executive committee rejected after extensive deliberation, caused significant delays.
1  The  the  DET  _  _  2  det
2  proposal  proposal  NOUN  _  _  13  nsubj
3  ,  ,  PUNCT  _  _  8  punct
4  which  which  PRON  _  _  8  obj
5  the  the  DET  _  _  7  det
6  executive  executive  ADJ  _  _  7  amod
7  committee  committee  NOUN  _  _  8  nsubj
8  rejected  reject  VERB  _  _  2  acl:relcl
9  after  after  ADP  _  _  11  case
10  extensive  extensive  ADJ  _  _  11  amod
11  deliberation  deliberation  NOUN  _  _  8  obl
12  ,  ,  PUNCT  _  _  2  punct
13  caused  cause  VERB  _  _  0  root
14  significant  significant  ADJ  _  _  15  amod
15  delays  delay  NOUN  _  _  13  obj
16  .  .  PUNCT  _  _  13  punct
"""
_NOMINAL = """# text = We commission a review of the committee's decisions because their implementation needs careful consideration.
1  We  we  PRON  _  _  2  nsubj
2  commission  commission  VERB  _  _  0  root
3  a  a  DET  _  _  4  det
4  review  review  NOUN  _  _  2  obj
5  of  of  ADP  _  _  9  case
6  the  the  DET  _  _  7  det
7  committee  committee  NOUN  _  _  9  nmod:poss
8  's  's  PART  _  _  7  case
9  decisions  decision  NOUN  _  _  4  nmod
10  because  because  SCONJ  _  _  13  mark
11  their  their  PRON  _  _  12  nmod:poss
12  implementation  implementation  NOUN  _  _  13  nsubj
13  needs  need  VERB  _  _  2  advcl
14  careful  careful  ADJ  _  _  15  amod
15  consideration  consideration  NOUN  _  _  13  obj
16  .  .  PUNCT  _  _  2  punct
"""
_PASSIVE = """# text = The report was written by the committee after the proposal had been rejected.
1  The  the  DET  _  _  2  det
2  report  report  NOUN  _  _  4  nsubj:pass
3  was  be  AUX  _  _  4  aux:pass
4  written  write  VERB  _  _  0  root
5  by  by  ADP  _  _  7  case
6  the  the  DET  _  _  7  det
7  committee  committee  NOUN  _  _  4  obl:agent
8  after  after  SCONJ  _  _  13  mark
9  the  the  DET  _  _  10  det
10  proposal  proposal  NOUN  _  _  13  nsubj:pass
11  had  have  AUX  _  _  13  aux
12  been  be  AUX  _  _  13  aux:pass
13  rejected  reject  VERB  _  _  4  advcl
14  .  .  PUNCT  _  _  4  punct
"""


def tokens(block: str) -> list[dict]:
    """The tokens of a block that has neither ranges nor empty nodes."""
    rows = [line.split() for line in block.splitlines() if line and line[0] != "#"]
    return [{"id": int(r[0]), "form": r[1], "lemma": r[2], "upostag": r[3], "head": int(r[6]), "deprel": r[7]} for r in rows]


EMBEDDED, NOMINAL, PASSIVE = ((block.splitlines()[0].removeprefix("# text = "), block) for block in (_EMBEDDED, _NOMINAL, _PASSIVE))
PARSES = [(text, tokens(block)) for text, block in (EMBEDDED, NOMINAL, PASSIVE)]
