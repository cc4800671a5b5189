"""Word lists for stand-in names, companies, emails and addresses.

Invented for this package; small by design, since a stand-in only has to look
plausible. The lists are fixed so that a value keeps its stand-in across runs.
"""

FIRST_NAMES = (
    "Ada Alan Beth Bruno Carla Cyril Dana Dmitri Elena Ezra Farah Felix Gina Gustav Hana Hugo "
    "Ines Ivan Jana Jonas Kira Klaus Lena Luca Maya Milo Nadia Nils Olga Omar Petra Quinn "
    "Rosa Ruben Sara Tariq Uma Viktor Wanda Yusuf"
).split()

LAST_NAMES = (
    "Abbott Baker Castro Dietrich Ellis Farrow Gruber Hansen Ibarra Jensen Keller Lindqvist Marsh "
    "Novak Okafor Petrov Quigley Rossi Sandoval Thorne Underhill Vargas Weber Xiong Yates Zeller "
    "Alvarez Brandt Coleman Dupont"
).split()

COMPANY_SUFFIXES = ["Inc", "LLC", "Group", "and Sons", "Ltd", "Partners"]
EMAIL_ENDINGS = ["com", "net", "org"]
UNIT_WORDS = ["Apt.", "Suite"]
