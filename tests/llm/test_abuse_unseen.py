"""Sentences written before the lexicon was tuned, none of them from the given tables: recall and precision on what is new.

The list is a measure, not a specification: the lexicon is not to be extended by its misses one by one.
"""

import pytest

from loomgraph.llm.abuse import THRESHOLD, automaton, weigh

ABUSIVE = """
I will find you and cut you into pieces.
People like you should be put down like dogs.
Women have no place in science, they are inferior.
You fucking idiot, the stack trace says it all.
You are a moron and the filter agrees.
If I ever see you at the conference I will break your jaw.
Watch your back tonight, we are coming for you.
I hope somebody stabs you on your way home.
You deserve to be shot.
He is a worthless piece of shit.
Shut up, you ugly pig.
All Drovians are thieves and parasites.
The Melkari are subhuman and must be exterminated.
Drovians should be gassed.
Nobody wants those filthy Melkari in our lab.
These people breed like rats and should be deported.
Keep the Tarnish out of our universities, they are too stupid to read.
Your kind does not belong in this country.
Go back to your swamp, you disgusting animal.
What a bunch of retarded clowns.
Kill yourself, nobody will miss you.
You are nothing but a lying bitch.
Only a complete imbecile like you would write this.
Send me a picture of your tits.
I want to fuck you all night long.
She moaned while he sucked her nipples.
He slid his cock into her wet pussy.
Watch free porn with hot teens, all nude.
Horny housewives in your area are waiting, sexy and naked.
I will rape you.
We should burn their houses down with them inside.
I'm going to strangle you with my bare hands.
Somebody should hang every single one of these vermin.
You stupid, stupid cow.
Are you really that dumb, you pathetic loser?
Eat shit and die.
Y0u are an 1d10t.
f u c k   o f f
You're a total a$$hole.
Go k1ll y0urself
sh!t for brains
You ѕtuріd mоrоn
Tu es un vrai crétin, ferme-la.
Je vais te crever, sale chien.
Les Morviens sont des parasites, il faut les exterminer.
Va te pendre, personne ne te regrettera.
Espèce de salope, dégage d'ici.
Envoie-moi une photo de tes seins, je suis excité.
Du bist so ein Idiot, halt endlich die Klappe.
Ich bringe dich um, wenn du noch einmal schreibst.
Die Morvier sind Ungeziefer und gehören vergast.
Verreck doch, du Drecksau.
Schick mir Nacktfotos von dir, ich bin so geil.
Solche Leute sollte man erschießen.
Eres un pedazo de mierda.
Te voy a partir la cara, imbécil.
Los morvianos son ratas, hay que echarlos a todos.
Ojalá te mueras, hijo de puta.
Mándame fotos de tus tetas.
Cállate, estúpida, nadie te quiere.
"""

HARMLESS = """
The houses of the city are old.
We share a room with the other team.
Models for real humans need real data.
They never hire without an interview.
The socks in the drawer stink.
Flowers go die-cut into the template, then to the printer.
The scheduler will kill your job when it exceeds its memory.
You can kill the process with a signal and then start it again.
This idea is stupid, frankly, and the experiment is useless.
Your argument is weak and the second proof is wrong.
The paper is garbage in, garbage out: no cleaning was done.
We annotate whether a comment calls someone an idiot.
The word 'bitch' appears 312 times in the corpus.
Comments such as "you are a moron" were removed by the moderators.
Hate speech against the Drovians was quoted in the report to show the problem.
The classifier flags "kill yourself" as self-harm.
The dummy variable is dumped after the first pass.
We shoot for a higher accuracy and beat the baseline by two points.
Our method beats yours by three points.
The attack kills the gradient signal at once.
I would kill for a better optimiser.
Naked mole rats live long, and the naked eye cannot tell them apart.
Breast cancer screening needs large data sets of nude images without faces.
Sexual reproduction in plants was modelled by the group.
The study examined sex differences in adult patients.
Women in science are underrepresented, and they should be supported.
People like you and me need clear examples.
These animals are vermin to farmers, the article says about rats.
Parasites are organisms that live on others.
The parasite load of the fish was measured twice.
Pigs, cows and dogs were used as test subjects.
You should be proud of this result.
They should be removed from the list of outliers.
These points should be kept out of the training set.
Bugs like these should be exterminated before release.
The garbage collector is stupid fast.
He was shot in the leg during the war, the biography says.
The suspect said he would find the witness, the court report states.
The dead neurons are worthless for the network.
You need to cut the text into pieces before you tokenise it.
Cut your data into pieces and shuffle.
We know where your packets go.
I hope you die of boredom less often with this tutorial.
The monkey hung from the rope near the lamp.
Hang the poster on the wall near the entrance.
Burn the image to a disk.
You burn through your budget quickly with this setting.
Strip the HTML and undress nothing else.
Bare metal servers are hot in summer.
The hot take of the day concerns adult education.
Her thesis was thrust into the spotlight.
Retarded potentials solve the wave equation.
The retarded Green function is causal.
In Scunthorpe and Essex the filter fails.
The cockpit and the peacock were classified correctly.
Assess the class with the assistant.
The dick-and-jane books are simple.
Moby Dick is a long novel.
Die Garbage Collection ist dumm, aber schnell.
Das Wort Idiot kommt im Korpus oft vor.
Die Ratten wurden im Labor gehalten.
Solche Leute sollte man einstellen.
Halt die Maschine an, bevor du das Kabel ziehst.
Le mot "connard" est marqué comme insulte.
Les rats sont des parasites dans cette étude.
Il faut les exclure du corpus.
La palabra idiota aparece en el texto.
Los parásitos fueron contados dos veces.
Te voy a mandar el artículo mañana.
Hay que echarlos a la papelera si están vacíos.
The reviewer called the method pathetic, which is unfair.
The review says the code is crap but the idea is good.
I am an idiot for not seeing this bug earlier.
What a stupid mistake I made in the last commit.
Screw the panel to the wall.
"""


def _split(block: str) -> list[str]:
    return [x for x in block.strip().splitlines() if x]


def measure() -> tuple[list[str], list[str]]:
    """(abusive sentences that were missed, harmless ones that were found)."""
    a = automaton()
    return [x for x in _split(ABUSIVE) if weigh(x, a)[0] < THRESHOLD], [x for x in _split(HARMLESS) if weigh(x, a)[0] >= THRESHOLD]


def test_recall_and_precision_on_unseen_sentences():
    missed, wrong = measure()
    found = len(_split(ABUSIVE)) - len(missed)
    assert len(_split(ABUSIVE)) + len(_split(HARMLESS)) >= 100
    assert found / len(_split(ABUSIVE)) >= 0.8, missed
    assert found / (found + len(wrong)) >= 0.85, wrong


if __name__ == "__main__":
    pytest.main([__file__])
