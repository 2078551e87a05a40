"""The starting lexicon of problem 3: general terms of abuse by class and language, runs of words built from small tables.

Terms are written from general knowledge of each language, not taken from any corpus; a table of one's own can be given instead
(``read`` takes lines of class, blank, term).  Terms of the labelled posts are learned on top (``abuse.learned_terms``).
"""

from __future__ import annotations

from itertools import product

#: Words of contempt.
INSULT = {
    "en": "idiot moron imbecile cretin dumbass dumb stupid fool loser scum scumbag bastard asshole arsehole arse bitch whore slut cunt twat wanker tosser dickhead prick dick cock fuck fucker motherfucker fuckface fuckwit shithead dipshit bullshitter jerk douche douchebag retard retarded pathetic worthless useless ugly filthy disgusting degenerate trash garbage coward clown brain-dead braindead halfwit nitwit dimwit lowlife skank hag swine pig crybaby numbskull bollocks git pillock",
    "es": "idiota imbécil estúpido tonto cretino inútil subnormal gilipollas cabrón capullo basura escoria puta puto zorra pendejo mamón cerdo payaso mierda mongólico retrasado",
    "fr": "imbécile idiot crétin abruti débile connard connasse salope salaud ordure pute merdeux minable bouffon taré dégénéré enculé enfoiré",
    "de": "idiot dummkopf vollidiot schwachkopf versager arschloch wichser trottel depp hurensohn schlampe fotze hure drecksau missgeburt abschaum spast penner spinner mistkerl",
    "pt": "idiota imbecil estúpido burro otário babaca cretino inútil lixo puta vadia cabrão filho-da-puta desgraçado palhaço retardado escroto",
    "it": "idiota imbecille stupido cretino cretina deficiente stronzo stronza coglione bastardo troia puttana merda sfigato ritardato verme pagliaccio",
    "ru": "идиот дурак дура тупица тварь урод мразь сука ублюдок придурок дебил кретин ничтожество гнида скотина шлюха мудак козёл",
    "ja": "ばか バカ 馬鹿 アホ あほ クズ くず ゴミ カス 間抜け キモい きもい ブス 死に損ない 能無し",
}
#: Animals, vermin, filth and sickness that groups of people are called, and words that deny that they are people.
HATE = {
    "en": "vermin subhuman subhumans parasite parasites cockroaches animals savages rats plague disease infestation invaders leeches filth thieves liars inferior deport exterminate cleansed",
    "es": "parásitos ratas alimañas cucarachas plaga asquerosos invasores subhumanos chusma",
    "fr": "parasites rats vermine cafards nuisibles répugnants envahisseurs sous-hommes racaille",
    "de": "ratten ungeziefer parasiten schmarotzer untermenschen abschaum gesindel invasoren",
    "pt": "parasitas ratos vermes baratas praga invasores nojentos escória",
    "it": "parassiti topi ratti vermi scarafaggi feccia invasori subumani",
    "ru": "паразиты крысы нелюди недочеловеки тараканы отребье мразь",
    "ja": "害虫 寄生虫 ゴキブリ 劣等",
}
#: Sexual content and offers of it.
SEXUAL = {
    "en": "porn porno xxx nsfw nude nudes naked sex sexy horny hardcore explicit fetish genitals boobs tits ass blowjob handjob cum orgasm masturbate escort hookup hookups uncensored bdsm milf pussy penis vagina threesome onlyfans camgirl erotic",
    "es": "sexo porno desnuda desnudo desnudas follar tetas culo polla coño erótico orgasmo",
    "fr": "sexe porno nue nues baiser seins chatte érotique orgasme",
    "de": "sex porno pornos nackt nackte nacktbilder ficken titten muschi schwanz erotik",
    "pt": "sexo porno pornô pelada pelado nua nuas foder peitos buceta erótico",
    "it": "sesso porno nuda nude nudi scopare tette figa cazzo erotico",
    "ru": "секс порно голая голые трахать сиськи эротика интим",
    "ja": "セックス エロ ポルノ 裸 巨乳 おっぱい",
}
#: Harm that is done to someone, and who it is done to.
HARM = {
    "en": ("kill hurt beat stab shoot strangle rape murder destroy punch smash burn break bury gut", "you your him her them those yourself"),
    "es": ("matar mataré matarte romper rompan reventar quemar golpear", "te la los las tu"),
    "fr": ("tuer casser cassera crever brûler frapper égorger", "te toi la ta tes les"),
    "de": ("töte töten umbringen schlagen verprügeln abstechen verbrennen", "dich dir euch sie"),
    "pt": ("matar mato quebrar queimar bater arrebentar", "você te sua seu vocês"),
    "it": ("ammazzo ammazzare uccido uccidere spacco bruciare", "te ti tua la vi"),
    "ru": ("убью убить зарежу сожгу сломаю изобью", "тебя тебе вас"),
}
#: Wishes and warnings as they are commonly put.
THREAT = """find you | find your | find out where you | know where you live | where you live | come for you | coming for you | make you regret | make you pay | regret this | you will regret | drop dead | disappear forever | go die | go and die | rot in hell | choke on |
hang yourself | kill yourself | kys | beating | burn down | your face | step outside | watch your back | better off dead | never have been born | te mataré | te voy a | te vas a arrepentir | arrepentir | muérete | vete a morir | voy a encontrar | ojalá te mueras |
je vais te | tu vas le regretter | regretter | va crever | crève | te retrouver | la figure | ich finde dich | bereuen | verrecke | die zähne | bring dich um | fahr zur hölle | ti ammazzo | devi morire | te ne pentirai | crepa | vai morrer | vai se arrepender | vou te | morra | сдохни | убью | пожалеешь | найду тебя |
死ね | しね | 殺す | 殺して | ぶっ殺 | くたばれ"""
#: Other runs of words of contempt, exclusion and sexual offers.
RUNS = {
    "insult": """shut up | fuck you | fuck off | screw you | piss off | get lost | go to hell | son of a bitch | piece of shit | piece of trash | piece of garbage | eat shit | eat dirt | crawl back | suck my | should be slapped | should be ashamed | ashamed of yourself | no one likes you |
        cállate | das asco | da asco | vete a la mierda | hijo de puta | ferme la | ferme ta gueule | ta gueule | va te faire | quelle honte | halt die klappe | halt die fresse | verpiss dich | zum kotzen | stück dreck | stück scheiße | vaffanculo | fai schifo | cala a boca | vai tomar | vai se foder | заткнись | пошёл ты | иди на""",
    "hate": """go back to where | where they came from | out of our country | out of the country | out of this country | thrown out | kicked out | sent back | wiped out | not human | called human | from our children | breed like | not welcome here | fuera de nuestro | echar a | del país | du pays | dehors les | raus aus | aus dem land | land gejagt | ausländer raus | fora do | fuori dal |
        вон из""",
    "sexual": """get laid | hook up | sex tape | no clothes | strip naked | dirty talk | no limits | adults only | bare body | my body | dm me | on cam | sugar daddy | sin límites | sans limites | ohne tabus | senza limiti | sem limites | без цензуры""",
}
#: What is said to be done to the unwanted: someone of these, a verb, you.
NOBODY = {
    "en": ("nobody no-one", "wants likes loves needs misses", "you"), "es": ("nadie", "te", "quiere soporta necesita"), "fr": ("personne", "ne", "veut t'aime"), "de": ("keiner niemand", "will mag braucht", "dich"), "it": ("nessuno", "ti", "vuole sopporta"), "pt": ("ninguém", "te", "quer suporta"), "ru": ("никто", "тебя", "любит ждёт"),
}
#: Things that someone is called a waste of, and what someone is told to give up.
WASTE, GIVE_UP = "space air oxygen skin life time", ("delete quit close", "your this", "blog account page")


def terms() -> dict[str, list[str]]:
    """The terms of each class."""
    split = lambda t: [x.strip() for x in t.replace("\n", " ").split("|")]
    every = lambda table: [w for t in table.values() for w in t.split()]
    runs = lambda *parts: [" ".join(p) for p in product(*(p.split() for p in parts))]
    harm = [x for a, b in HARM.values() for x in runs(a, b)]
    nobody = [x.replace("no-one", "no one") for parts in NOBODY.values() for x in runs(*parts)]
    return {
        "insult": every(INSULT) + split(RUNS["insult"]) + nobody + [f"waste of {w}" for w in WASTE.split()] + runs(*GIVE_UP),
        "threat": split(THREAT) + harm,
        "hate": every(HATE) + split(RUNS["hate"]),
        "sexual": every(SEXUAL) + split(RUNS["sexual"]),
    }


def read(path: str) -> dict[str, list[str]]:
    """The terms of a file of lines, each a class, blanks and a term; blank lines and those that begin with # are left out."""
    out: dict[str, list[str]] = {}
    with open(path, encoding="utf-8") as f:
        for line in f:
            kind, _, term = line.strip().partition(" ")
            if term.strip() and not kind.startswith("#"):
                out.setdefault(kind, []).append(term.strip())
    return out
