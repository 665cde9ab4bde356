"""Word lists and lookup tables of the name and note operators.

All of them are fixed values: the results hang on them. Code that uses them is elsewhere.
"""

from __future__ import annotations

# --- fixed values: accent rules (pattern, replacement), in their order; any case.
ACCENT_RULES = [
    (r"\bshon\b", "sean"), (r"\bshawn\b", "sean"), (r"\bniv\b", "niamh"), (r"\bneev\b", "niamh"), (r"\baife\b", "aoife"), (r"\beefa\b", "aoife"),
    (r"\bkeeran\b", "ciaran"), (r"\bkiran\b", "ciaran"), (r"\bkieran\b", "ciaran"), (r"\bgranya\b", "grainne"), (r"\bsineadh?\b", "sinead"),
    (r"\bnoola\b", "nuala"), (r"\bmev\b", "maeve"), (r"\bmaev\b", "maeve"), (r"\bmeev\b", "maeve"), (r"\bkeeva\b", "caoimhe"),
    (r"\bkweva\b", "caoimhe"), (r"\bleesha\b", "laoise"), (r"\bfeekra\b", "fiachra"), (r"\bowan\b", "eoghan"), (r"\bewon\b", "eoghan"),
    (r"\broree\b", "ruairi"), (r"\brooree\b", "ruairi"), (r"\bfarrel\b", "fearghal"), (r"\bsive\b", "sadhbh"), (r"\bsyve\b", "sadhbh"),
    (r"\borla\b", "orlaith"), (r"\borlaw\b", "orlaith"), (r"\bsorka\b", "sorcha"), (r"\bsurka\b", "sorcha"), (r"\bkilian\b", "cillian"),
    (r"\bkillian\b", "cillian"), (r"\bdermid\b", "diarmuid"), (r"\bdermot\b", "diarmuid"), (r"\bbreed\b", "brigid"), (r"\bbreed\b", "brid"),
    (r"\bconker\b", "conor"), (r"\bconkur\b", "conor"), (r"\bpaurik\b", "padraig"), (r"\bpadrig\b", "padraig"), (r"\baishlin\b", "aisling"),
    (r"\bashling\b", "aisling"), (r"\bashleen\b", "aisling"), (r"\btige\b", "tadhg"), (r"\bteague\b", "tadhg"), (r"\bdeerdra\b", "deirdre"),
    (r"\bdarag\b", "darragh"), (r"\bcloda\b", "clodagh"), (r"\bronen\b", "ronan"), (r"\bbrenden\b", "brendan"), (r"\bsined\b", "sinead"),
    (r"\bfinn\b", "fionn"), (r"\bfin\b", "fionn"), (r"\boneill\b", "oneill"), (r"\boreilly\b", "oreilly"), (r"\bosullivan\b", "osullivan"),
    (r"\bodonel\b", "odonnell"), (r"\bohara\b", "ohara"), (r"\boshe\b", "oshea"), (r"\bmccarty\b", "mccarthy"), (r"\bmakarti\b", "mccarthy"),
    (r"\bkeli\b", "kelly"), (r"\bmurfy\b", "murphy"), (r"\bnolen\b", "nolan"), (r"\bnolan\b", "nolan"), (r"\brayen\b", "ryan"),
    (r"\brayan\b", "ryan"), (r"\bdoyel\b", "doyle"), (r"\blinch\b", "lynch"), (r"\bmcgrat\b", "mcgrath"), (r"\bkavanah\b", "kavanagh"),
    (r"\bgalger\b", "gallagher"), (r"\bgallager\b", "gallagher"), (r"\bbrenen\b", "brennan"), (r"\bbrenan\b", "brennan"), (r"\bvargis\b", "varghese"),
    (r"\bvargees\b", "varghese"), (r"\bvargese\b", "varghese"), (r"\bchako\b", "chacko"), (r"\bjacko\b", "chacko"), (r"\bpillay\b", "pillai"),
    (r"\bpilli\b", "pillai"), (r"\bkurop\b", "kurup"), (r"\bjorj\b", "george"), (r"\btomas\b", "thomas"), (r"\bmathu\b", "mathew"),
    (r"\bjosif\b", "joseph"), (r"\bnayr\b", "nair"), (r"\bmenoan\b", "menon"), (r"\bkrishnen\b", "krishnan"), (r"\biyar\b", "iyer"),
    (r"\biyyer\b", "iyer"), (r"\btankachan\b", "thankachan"), (r"\bbaboo\b", "babu"), (r"\bsooresh\b", "suresh"), (r"\bshuresh\b", "suresh"),
    (r"\bsantosh\b", "santhosh"), (r"\bbindhu\b", "bindu"), (r"\bsreejit\b", "sreejith"), (r"\bsreejeet\b", "sreejith"), (r"\bnambear\b", "nambiar"),
    (r"\bnambiyar\b", "nambiar"), (r"\bo\s+neil\b", "oneill"), (r"\bo\s+brien\b", "obrien"), (r"\bo\s+reilly\b", "oreilly"),
    (r"\bo\s+hara\b", "ohara"), (r"\bo\s+shea\b", "oshea"), (r"\bo\s+donnell\b", "odonnell"),
]

MALE_FIRST_NAMES = """
Aidan Aaron Barry Brian Brendan Cathal Cian Ciarán Cillian Colm Conor Cormac Darragh Declan Denis
Dermot Diarmuid Donal Dylan Eamon Eoin Fergal Fiachra Fionn Gary Gerard Hugh James John Kevin Kieran
Liam Mark Michael Muiris Niall Oisín Pádraig Patrick Paul Peter Philip Rónán Ronan Ruairí Ryan Seamus
Sean Shane Stephen Thomas Tim Tony Vincent William Conal Donnacha Fearghal Lorcan Tadhg
""".split()

FEMALE_FIRST_NAMES = """
Áine Aisling Aoife Bríd Brigid Caitlin Caoimhe Caroline Ciara Claire Clodagh Deirdre Eileen Eimear
Emer Emma Fiona Fionnuala Gráinne Helen Joan Kathleen Lauren Maeve Máire Margaret Mary Michelle Niamh
Nóra Nuala Orla Patricia Rachel Roisin Rónán Saoirse Sharon Sinéad Siobhán Sorcha Susan Tracey Una
Áine Blathnaid Clíona Eithne Laoise Méabh Muireann Niamh Orlaith Sadhbh Treasa Ann Anne Catherine
Christine Lisa
""".split()

SURNAMES = """
Barry Brady Brennan Burke Byrne Campbell Clarke Collins Connolly Connor Cullen Daly Donnelly Doyle
Dunne Farrell Fitzgerald Fitzpatrick Flynn Foley Gallagher Griffin Hayes Healy Hughes Johnston Kelly
Kennedy Lynch Maher Malone Mathews McCarthy McDonagh McGrath McLoughlin Moore Moran Moriarty Morris
Murphy Murray Nolan O'Brien O'Callaghan O'Carroll O'Connor O'Doherty O'Donnell O'Donoghue O'Gorman
O'Herlihy O'Keeffe O'Mahony O'Neill O'Reilly O'Riordan O'Sullivan Power Quinn Riordan Ryan Sheridan
Smith Sweeney Thompson Walsh White Wilson Fitzgibbon Bourke Broderick Delaney Fanning Hogan Keane
Kearney Kinsella Lawlor Lennon Loftus Meagher Moloney Mulcahy Nagle
""".split()

#: Spoken variant and canonical name.
PHONETIC_VARIANTS = [
    ("shivawn", "Siobhán"), ("shivon", "Siobhán"), ("shavon", "Siobhán"), ("shivaan", "Siobhán"), ("keeva", "Caoimhe"), ("kweeva", "Caoimhe"),
    ("caoimhe", "Caoimhe"), ("neev", "Niamh"), ("neeav", "Niamh"), ("niv", "Niamh"), ("eersha", "Saoirse"), ("searsha", "Saoirse"),
    ("seersha", "Saoirse"), ("ashling", "Aisling"), ("ashleen", "Aisling"), ("ayshling", "Aisling"), ("eefa", "Aoife"), ("eefah", "Aoife"),
    ("aifa", "Aoife"), ("orla", "Orla"), ("orlagh", "Orla"), ("sorcha", "Sorcha"), ("surra", "Sorcha"), ("granya", "Gráinne"), ("grainne", "Gráinne"),
    ("grawn ya", "Gráinne"), ("maeve", "Maeve"), ("mayve", "Maeve"), ("sinead", "Sinéad"), ("shinade", "Sinéad"), ("shunaid", "Sinéad"),
    ("deirdre", "Deirdre"), ("derdree", "Deirdre"), ("nuala", "Nuala"), ("noola", "Nuala"), ("fionnuala", "Fionnuala"), ("finnoola", "Fionnuala"),
    ("finula", "Fionnuala"), ("eimer", "Eimear"), ("aimer", "Eimear"), ("emer", "Emer"), ("clodagh", "Clodagh"), ("cloda", "Clodagh"),
    ("blathnaid", "Blathnaid"), ("blahnid", "Blathnaid"), ("taig", "Tadhg"), ("tig", "Tadhg"), ("tague", "Tadhg"), ("tierna", "Tiernan"),
    ("caran", "Ciarán"), ("kiaran", "Ciarán"), ("kieran", "Ciarán"), ("conan", "Conal"), ("oishin", "Oisín"), ("ushin", "Oisín"), ("rori", "Ruairí"),
    ("rory", "Ruairí"), ("ruree", "Ruairí"), ("padraig", "Pádraig"), ("podraig", "Pádraig"), ("pawrick", "Pádraig"), ("donokha", "Donnacha"),
    ("donnakha", "Donnacha"), ("feargal", "Fearghal"), ("fergle", "Fearghal"), ("lorcan", "Lorcan"), ("lurcan", "Lorcan"), ("diarmid", "Diarmuid"),
    ("dermid", "Diarmuid"), ("jarmed", "Diarmuid"), ("laisha", "Laoise"), ("leesha", "Laoise"), ("meave", "Méabh"), ("medb", "Méabh"),
    ("mave", "Méabh"), ("eamon", "Eamon"), ("aymon", "Eamon"), ("aimon", "Eamon"), ("shaymus", "Seamus"), ("shamus", "Seamus"), ("shaun", "Sean"),
    ("shawn", "Sean"), ("shan", "Sean"), ("reilly", "O'Reilly"), ("oreilly", "O'Reilly"), ("brien", "O'Brien"), ("obrien", "O'Brien"),
    ("connor", "O'Connor"), ("oconnor", "O'Connor"), ("sullivan", "O'Sullivan"), ("osullivan", "O'Sullivan"), ("neill", "O'Neill"),
    ("oneill", "O'Neill"), ("donnell", "O'Donnell"), ("odonnell", "O'Donnell"), ("mahony", "O'Mahony"), ("omahony", "O'Mahony"),
    ("keeffe", "O'Keeffe"), ("okeeffe", "O'Keeffe"), ("callaghan", "O'Callaghan"), ("ocallaghan", "O'Callaghan"), ("donoghue", "O'Donoghue"),
    ("odonoghue", "O'Donoghue"), ("doherty", "O'Doherty"), ("odoherty", "O'Doherty"), ("riordan", "O'Riordan"), ("oriordan", "O'Riordan"),
    ("carroll", "O'Carroll"), ("ocarroll", "O'Carroll"), ("macarthy", "McCarthy"), ("mccarthy", "McCarthy"), ("mcloughlin", "McLoughlin"),
    ("mclafflin", "McLoughlin"), ("mcgrath", "McGrath"), ("makgrath", "McGrath"), ("mcdonagh", "McDonagh"), ("makdonagh", "McDonagh"),
]

CURATED_NAMES = """
Mary Murphy, Kathleen Kelly, Margaret Walsh, Brigid O'Sullivan, Joan Ryan, Ann Byrne, Patricia O'Brien,
Helen Collins, Eileen Doyle, Nóra Lynch, Anne Murray, Máire Quinn, Sinéad Moore, Siobhán Gallagher,
Niamh Kennedy, Aoife Farrell, Aisling Nolan, Caoimhe Burke, Roisin Hayes, Clodagh Campbell,
Saoirse Griffin, Orla Sweeney, Ciara Brennan, Fiona Fitzgerald, Deirdre McCarthy, Gráinne McLoughlin,
Nuala O'Carroll, Eimear Cullen, Maeve Power, Sorcha Sheridan, John Murphy, Patrick Kelly,
Michael Walsh, James O'Sullivan, Thomas Ryan, William Byrne, David O'Brien, Stephen Collins,
Kevin Doyle, Brian Lynch, Paul Murray, Mark Quinn, Conor Moore, Seamus Gallagher, Ciarán Kennedy,
Liam Farrell, Eoin Nolan, Cormac Burke, Declan Hayes, Ronan Campbell, Darragh Griffin, Barry Sweeney,
Shane Brennan, Gary Fitzgerald, Niall McCarthy, Oisín McLoughlin, Pádraig O'Carroll, Tadhg Cullen,
Ruairí Power, Fionn Sheridan, Daniel Ryan, John Doyle, Marcus O'Reilly, Anne Kelly, Emma Thompson,
Mary Collins, Sarah Johnson, Lisa Chen, Peter O'Brien, Catherine Walsh, Elizabeth Murphy,
Frances Byrne, Gerard Connolly, Hugh Daly, Ivan Donnelly, Joseph Flynn, Kenneth Foley,
Lawrence Hughes, Martin Johnston, Noel Keane, Oliver Kearney, Raymond Kinsella, Samuel Lawlor,
Victor Lennon, Walter Malone, Arthur McGrath, Bernard Moriarty, Charles Moran, Dennis Maher,
Edward Riordan, Francis White, George Wilson, Harold Bourke, Irene Broderick, Jacqueline Delaney,
Katharine Fanning, Lorraine Hogan, Monica Meagher, Nancy Moloney, Olive Mulcahy, Pamela Nagle,
Queenie Fitzgibbon, Rosemary Loftus, Teresa Fitzpatrick, Ursula O'Gorman, Veronica O'Herlihy,
Winifred O'Keeffe, Yvonne O'Mahony
"""

HONORIFICS = "mr mrs ms miss dr prof professor nurse patient resident carer sr jr rev reverend sir dame".split()

CAPITAL_STOP_WORDS = """
monday tuesday wednesday thursday friday saturday sunday january february march april june july august
september october november december ward unit room ireland dublin cork galway recording report staff
carer doctor nurse patient
""".split()

ENTITY_STOP_WORDS = """
he she they him her his the a an resident nurse patient doctor staff carer room ward unit care home
recording report palliative approach corner bottle bed bandage intake discomfort aggression behavior
behaviour confusion technique application condition decline stated observed reported required performed
daily weekly monthly yesterday today tomorrow morning afternoon evening overnight community
""".split()
#: The name corrector's list has these as well.
MORE_ENTITY_STOP_WORDS = "pain skin fall falls oral fluid".split()

RESTORED_PREFIXES = "PATIENT NURSE DOCTOR CARER STAFF".split()
PROTECTED_PREFIXES = "PATIENT NURSE STAFF DOCTOR CARER MANAGER RESIDENT".split()

REFUSAL = r"\b(?:refus(?:ed|es|ing)|won'?t\s+take|not\s+taking|declin(?:ed|es|ing))\b"
AGENCY = r"\b(?:self[\s-]removed|self[\s-]discon|patient\s+removed|patient\s+pulled|patient\s+got\s+up|pulled\s+out\s+(?:own|their|his|her))\b"
RECURRENCE = r"\b(?:again(?:\s+again)?|keeps?\s+\w+ing|every\s+night|same\s+as\s+before|recurring|persistent|repeated|second\s+occurrence)\b"
EXCUSES = ("declined", "rdh")
#: What a rewriter may put before its text, at the text's start alone.
PREAMBLE = r"(?i)\A(?:```[a-z]*\n?|sure[,!\s]+|of\s+course[,!\s]+|here(?:'s|\s+is|\s+are)[^:\n]{0,80}?:\s*|corrected[^:\n]{0,60}?:\s*|(?:clinical\s+)?note[:\s]+|output[:\s]+|result[:\s]+|below\s+is[^:\n]{0,60}?:\s*)+"
# --- end of fixed values


def accent_rules() -> list[tuple[str, str]]:
    """(pattern, replacement), in order; patterns match whole words."""
    return list(ACCENT_RULES)


def phonetic_variants() -> dict[str, str]:
    return dict(PHONETIC_VARIANTS)


def curated_names() -> list[str]:
    return list(dict.fromkeys(x.strip() for x in CURATED_NAMES.split(",")))


#: Function words of English, French, German and Spanish: no names where they stand alone, even at the beginning of a sentence.
FUNCTION_WORDS = """
a about after all also although an and any are as at be because been before both but by can could did do does during each either else ever every few for
from had has have he her here him his how however i if in into is it its just later less many may me might more most much must my near neither never next no nor
not now of off often on once one only or other our out over own per perhaps quite rather same she should since so some soon still such than that the their them
then there these they this those though through to today too under until up upon us very was we well were what when where whether which while who whose why will
with within without would yes yet you your
au aussi autre aux avant avec bien car ce cela ces cet cette chaque chez comme dans de depuis des donc du elle elles en encore entre est et eux ici il ils
je la le les leur lors lui mais même mes moins mon ne ni nos notre nous on ont ou où par pas peu plus pour puis quand que quel qui sa sans se ses si son sont sous
sur ta toujours tous tout toute très tu un une vers vos votre vous
aber alle als also am an auch auf aus bei bin bis da dann das dass dem den denn der des die dies diese dir doch dort du durch ein eine einem einen einer er es
für gegen hat hier ich ihm ihn ihr im immer in ist ja jede jetzt kein man mehr mein mit nach nicht noch nun nur ob oder ohne schon sehr sein seit sich sie sind so
über um und uns unter viel vom von vor war was weil wenn wer wie wieder wir wird wo zu zum zur zwischen
al algo ante antes aquí así aún ayer hoy luego siempre hoy heute gestern morgen bajo cada casi como con contra cual cuando de del desde donde durante el él ella ellos en entre era es esa ese esta este está
fue ha hasta hay la las le les lo los luego más me mi mientras muy nada ni no nos o otra otro para pero poco por porque que qué quien se según ser si sí sin
sobre son su sus también tan te tiene todo tras tu un una uno unos usted y ya yo
""".split()


def function_words() -> list[str]:
    return list(dict.fromkeys(FUNCTION_WORDS))


def first_names() -> list[str]:
    return list(dict.fromkeys(MALE_FIRST_NAMES + FEMALE_FIRST_NAMES))
