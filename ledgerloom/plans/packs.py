"""Starter rules by name, to copy from and to try things with. A line per rule: title, condition, category, flags."""

from __future__ import annotations

from ledgerloom.plans.rules import Rule, RuleError, parse_action, parse_condition

RETAIL = """
Weekly shop at Waitrose | counterparty ~ "WAITROSE*" | Groceries | food
Weekly shop at Carrefour | counterparty ~ "*CARREFOUR*" | Groceries | food
Weekly shop at Rewe | counterparty ~ "REWE *" | Groceries | food
Bulk buy at Costco | counterparty ~ "COSTCO WHSE*" | Groceries | food bulk
Flat packs | counterparty ~ "IKEA*" | Household | furniture
Tools and paint | counterparty ~ "*SCREWFIX*" | Household | repairs
Sports kit | counterparty ~ "DECATHLON*" | Leisure | sport
"""
TRANSPORT = """
Rides by Lyft | counterparty ~ "LYFT *" | Getting about | ride
Rides by Bolt | counterparty ~ "BOLT.EU*" | Getting about | ride
German trains | counterparty ~ "DB VERTRIEB*" | Getting about | train
French trains | counterparty ~ "SNCF*" | Getting about | train
Petrol at Total | counterparty ~ "TOTALENERGIES*" | Car | petrol
Charging posts | counterparty ~ "*CHARGEPOINT*" | Car | electricity
Car parks | memo ~ "*parking*" | Car | parking
"""
SUBSCRIPTIONS = """
Music by Deezer | counterparty ~ "DEEZER*" | Recurring | music
Films by Mubi | counterparty ~ "*MUBI*" | Recurring | film
Code hosting | counterparty ~ "GITHUB*" | Recurring | software
Notes app | counterparty ~ "EVERNOTE*" | Recurring | software
A paper a day | memo ~ "*newspaper*monthly*" | Recurring | press
"""
TRAVEL = """
Flights with KLM | counterparty ~ "KLM *" | Trips | flight
Flights with Lufthansa | counterparty ~ "LUFTHANSA*" | Trips | flight
Hostel beds | counterparty ~ "*HOSTELWORLD*" | Trips | bed
Rooms by Accor | counterparty ~ "ACCOR*" | Trips | bed
Hired cars | counterparty ~ "SIXT *" | Trips | car
"""
FINANCIAL = """
Price of the account | memo ~ "*monthly account price*" | Cost of money | account
Price of a late payment | memo ~ "*late payment*" | Cost of money | late
Earned on savings | memo ~ "*savings*earned*" | Income | savings
Paid out by shares | memo ~ "*dividend*" | Income | shares
Money changed | counterparty ~ "WISE PAYMENTS*" | Cost of money | exchange
"""
COMPLIANCE = """
Out of the ordinary, paid | amount in -100000000..-25000 | | look-high
Out of the ordinary, received | amount in 25000..100000000 | | look-high
Round thousands | amount ~ "*000.0" | | look-round
Paid in coins of the net | counterparty ~ "*COINBASE*" | | look-crypto
"""
SANITY = """
Nobody named | counterparty ~ "" | | check-name
Nothing moved | amount == 0 | | check-amount
Named as a test | memo ~ "*lorem ipsum*" | | check-memo
"""
EXAMPLES = """
One name, in any case | counterparty == "corner bakery" | Shown by example | example
How a name begins | counterparty ~ "CORNER*" | Shown by example | example
Words in turn | counterparty ~ "*HARBOUR*FERRY*" | Shown by example | example
A span of amounts | amount in -9.99..-1 | Shown by example | example
Two flags and no category | memo ~ "*two flags*" | | first second
"""
PACKS = {
    "retail": RETAIL,
    "transport": TRANSPORT,
    "subs": SUBSCRIPTIONS,
    "subscriptions": SUBSCRIPTIONS,
    "travel": TRAVEL,
    "financial": FINANCIAL,
    "compliance": COMPLIANCE,
    "sanity": SANITY,
    "examples": EXAMPLES,
}


def pack(name: str) -> list[Rule]:
    """The rules of a pack; an unknown name is an error that lists the known ones."""
    if name not in PACKS:
        raise RuleError(f"no pack named {name!r}; there are {', '.join(PACKS)}")
    rules = []
    for line in PACKS[name].strip().splitlines():
        title, condition, category, flags = (part.strip() for part in line.split("|"))
        actions = [f'category = "{category}"'] * bool(category) + [f'flags += "{flag}"' for flag in flags.split()]
        rules.append(Rule(title, (parse_condition(condition),), tuple(map(parse_action, actions))))
    return rules


def as_text(rules: list[Rule]) -> str:
    """Rules as text that :func:`ledgerloom.plans.rules.parse_rules` reads."""
    block = lambda r: "\n".join([f'rule "{r.name}" {{', "  match:", *(f"    - {c.source}" for c in r.match), "  set:", *(f"    - {a.source}" for a in r.set), "}", ""])
    return "\n".join(map(block, rules))
