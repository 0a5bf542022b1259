"""The checks dimension: 64 rows, of which 48 are computed here."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

# Check id, severity, fix class, method, whether this engine computes it,
# and a title of our own.
CHECKS = [
    ("S1", "P0", "manual", "static", True, "Live provider credential written into a file"),
    ("S2", "P0", "assisted", "static", True, "Secret carried by a variable the browser bundle receives"),
    ("S3", "P0", "auto", "config", True, "Secret file that the ignore list does not cover"),
    ("S4", "P0", "manual", "static", True, "Secret file was added at some point in history"),
    ("S5", "P2", "auto", "static", True, "Setting read in code but not documented"),
    ("S6", "P2", "auto", "config", True, "Source maps switched on for production"),
    ("D1", "P0", "assisted", "config", True, "Table without row level security"),
    ("D2", "P0", "assisted", "config", True, "Write policy that lets every caller through"),
    ("D3", "P0", "assisted", "static", True, "Service role key used where the client can reach it"),
    ("D4", "P0", "assisted", "config", True, "Storage bucket marked public"),
    ("D5", "P0", "assisted", "semantic", False, "Record looked up by caller's id without an owner test"),
    ("D6", "P0", "assisted", "semantic", False, "Permission test done only in the client"),
    ("D7", "P1", "assisted", "semantic", False, "Request body stored without a field list"),
    ("D8", "P0", "assisted", "static", True, "SQL text built from interpolated values"),
    ("D9", "P0", "assisted", "config", True, "Database rules open to everyone"),
    ("A1", "P0", "assisted", "semantic", False, "Writing endpoint without a session test"),
    ("A2", "P0", "assisted", "static", True, "Token verification switched off or weak"),
    ("A3", "P1", "auto", "static", True, "Session cookie without protective flags"),
    ("A4", "P1", "assisted", "semantic", False, "Login or reset route without throttling"),
    ("A5", "P1", "auto", "static", True, "Any origin allowed by the API"),
    ("A6", "P0", "assisted", "static", True, "Password hashed with a fast digest"),
    ("R1", "P1", "auto", "static", True, "Component tree without an error boundary"),
    ("R2", "P1", "assisted", "static", True, "Response read without a status test"),
    ("R3", "P1", "auto", "static", True, "Network call without a time limit"),
    ("R4", "P1", "assisted", "semantic", False, "Input accepted without a schema"),
    ("R5", "P1", "assisted", "static", True, "Error caught and thrown away"),
    ("R6", "P1", "assisted", "semantic", False, "Public endpoint without throttling"),
    ("R7", "P2", "assisted", "semantic", False, "Data view without loading or error state"),
    ("R8", "P2", "assisted", "semantic", False, "List rendered without pages"),
    ("R9", "P2", "auto", "static", True, "Database call whose promise nobody awaits"),
    ("C1", "P2", "assisted", "semantic", False, "Query run once per loop step"),
    ("C2", "P2", "auto", "static", True, "Filter or sort column without an index"),
    ("C3", "P2", "assisted", "static", True, "Select of all rows without a limit"),
    ("C4", "P1", "assisted", "static", True, "Endless loop in a request handler"),
    ("C5", "P2", "assisted", "static", True, "Polling more often than every 30 seconds"),
    ("C6", "P2", "assisted", "static", True, "Caching switched off for a route"),
    ("C7", "P2", "assisted", "semantic", False, "Parallel calls without an upper bound"),
    ("C8", "P2", "assisted", "semantic", False, "Whole table read to compute one number"),
    ("P1", "P0", "manual", "net", True, "Dependency unknown to its registry"),
    ("P2", "P1", "manual", "net", True, "Dependency name one edit from a popular one"),
    ("P3", "P1", "auto", "config", True, "Manifest without a lockfile"),
    ("P4", "P1", "assisted", "net", False, "Dependency with a published vulnerability"),
    ("P5", "P2", "manual", "config", True, "Locked package that runs an install script"),
    ("O1", "P0", "auto", "static", True, "Sensitive value passed to a log call"),
    ("O2", "P1", "auto", "static", True, "Internal error text sent to the caller"),
    ("O3", "P3", "assisted", "static", True, "Console calls used as logging"),
    ("O4", "P2", "manual", "config", True, "No error tracking in the project"),
    ("O5", "P3", "auto", "config", True, "No health endpoint in the project"),
    ("H1", "P1", "auto", "config", True, "No history to go back to"),
    ("H2", "P2", "assisted", "static", True, "Leftover copy of a module"),
    ("H3", "P3", "assisted", "static", True, "Module that nothing imports"),
    ("H4", "P2", "assisted", "semantic", False, "Two implementations of one concern"),
    ("H5", "P1", "assisted", "static", True, "Sample data or unfinished note in server code"),
    ("H6", "P3", "auto", "static", True, "Block of code left as comments"),
    ("H7", "P3", "manual", "static", True, "Module longer than the limit"),
    ("H8", "P3", "assisted", "static", True, "Block copied three or more times"),
    ("X1", "P1", "auto", "config", True, "Debug mode on in configuration"),
    ("X2", "P1", "auto", "config", True, "No security headers configured"),
    ("X3", "P1", "assisted", "static", True, "Redirect target taken from the request"),
    ("X4", "P0", "assisted", "semantic", False, "Internal route without a guard"),
    ("X5", "P1", "manual", "config", False, "Preview deployment open to everyone"),
    ("T1", "P2", "manual", "config", True, "No tests or a placeholder test script"),
    ("T2", "P3", "manual", "static", True, "Test without an assertion"),
    ("T3", "P2", "auto", "config", True, "No continuous integration workflow"),
]

# Why each check matters and what mends it, in words of our own.
ADVICE = {
    "S1": ("Whoever reads the code can act with the account behind the key.",
           "Revoke the key, then load its successor from the environment."),
    "S2": ("Values with a public prefix are shipped to every browser.",
           "Rename the setting without the prefix and read it on the server."),
    "S3": ("The next commit may publish the secrets the file holds.",
           "Add the file to the ignore rules and take it out of the index."),
    "S4": ("Deleting a file leaves its old content in the history.",
           "Replace every secret it held; rewrite the history if it was shared."),
    "S5": ("A new installation fails on settings nobody knows of.",
           "Name the setting, with a harmless value, in the example file."),
    "S6": ("Source maps hand the original code to every visitor.",
           "Switch them off for production or upload them to a private store."),
    "D1": ("Any client key can read and write the table.",
           "Enable row security and add a policy for each kind of access."),
    "D2": ("A policy that is always true is no policy.",
           "Tie the policy to the caller's identity."),
    "D3": ("The key of the service passes every access rule.",
           "Move the call to server code and give the client the public key."),
    "D4": ("Everything in the bucket can be fetched by anyone.",
           "Make the bucket private and hand out signed addresses."),
    "D5": ("Changing a number in the address shows another customer's record.",
           "Add the owner to the condition of the query."),
    "D6": ("A client can skip what only the client checks.",
           "Repeat the test where the data is read or written."),
    "D7": ("Callers can set fields they were never meant to set.",
           "Pick the accepted fields by name."),
    "D8": ("Input that is pasted into a statement can change it.",
           "Pass values as parameters."),
    "D9": ("The whole database is open to reading and writing.",
           "Require a signed-in user and test the owner in each rule."),
    "A1": ("Anyone can call an endpoint that changes data.",
           "Look up the session first and refuse without one."),
    "A2": ("Forged tokens are accepted.",
           "Verify with a named algorithm and a secret from the environment."),
    "A3": ("Scripts or other sites can use the session.",
           "Set the flags for http only and same site."),
    "A4": ("Passwords can be guessed as fast as the network allows.",
           "Limit attempts by account and address."),
    "A5": ("Every site can call the interface from its visitors' browsers.",
           "List the origins that are meant to call it."),
    "A6": ("Fast digests can be reversed by trying passwords.",
           "Use a slow password hash with a salt."),
    "R1": ("One failing component blanks the whole page.",
           "Wrap the tree in a boundary that shows a message."),
    "R2": ("Error pages are read as if they were data.",
           "Test the status before the body is used."),
    "R3": ("A silent peer blocks the caller for good.",
           "Give every call a time limit."),
    "R4": ("Odd input reaches code that never expected it.",
           "Check input against a schema at the border."),
    "R5": ("Failures disappear without a trace.",
           "Log the error, handle it, or let it rise."),
    "R6": ("A single caller can use up the service.",
           "Limit requests by caller."),
    "R7": ("Users see an empty view while data loads or fails.",
           "Show the loading and the failed state."),
    "R8": ("The list grows until it no longer loads.",
           "Fetch a page at a time."),
    "R9": ("The response is sent before the write is done, or lost.",
           "Await the call."),
    "C1": ("The number of queries grows with the number of rows.",
           "Fetch all rows of the loop in one query."),
    "C2": ("Each query scans the table.",
           "Create an index on the column."),
    "C3": ("The result grows with the table.",
           "Add a limit or a range."),
    "C4": ("A request never ends and is billed until it is killed.",
           "Move the work to a queue or bound the loop."),
    "C5": ("Every open page keeps the server busy.",
           "Poll less often or push changes."),
    "C6": ("Each visit pays for work that could be shared.",
           "Cache the route for as long as its data allows."),
    "C7": ("A burst starts as many calls as there are items.",
           "Run a fixed number at a time."),
    "C8": ("Rows travel only to be counted.",
           "Let the database compute the number."),
    "P1": ("Anyone may register the name and ship code under it.",
           "Remove it or correct its name."),
    "P2": ("A near name may be an imitation.",
           "Compare it with the package that was meant."),
    "P3": ("Two installations may hold different code.",
           "Commit the lockfile."),
    "P4": ("A known flaw is part of the build.",
           "Update to a version without it."),
    "P5": ("Installing runs code nobody has read.",
           "Read the script, or install without scripts."),
    "O1": ("Logs are copied, kept and read by many.",
           "Leave the value out or mask it."),
    "O2": ("Error texts show callers how the system is built.",
           "Log the details and answer with a general message."),
    "O3": ("Output without levels and structure cannot be searched.",
           "Use the project's logger."),
    "O4": ("Failures in production are noticed by users only.",
           "Send errors to a tracker."),
    "O5": ("Nothing can tell whether the service is up.",
           "Add an endpoint that tests what the service needs."),
    "H1": ("There is no earlier state to return to.",
           "Put the project under version control and commit often."),
    "H2": ("Fixes go to one of the copies.",
           "Keep the one in use and delete the others."),
    "H3": ("Code that nothing uses still has to be read.",
           "Delete it or import it."),
    "H4": ("Two ways of doing one thing drift apart.",
           "Choose one and move its callers."),
    "H5": ("Visitors may be served made-up data.",
           "Finish the code or remove it from the server."),
    "H6": ("Dead lines hide the live ones.",
           "Delete them; the history keeps them."),
    "H7": ("Nobody holds a file of this length in mind.",
           "Split it by what its parts do."),
    "H8": ("A change has to be made in every copy.",
           "Move the block to a function."),
    "X1": ("Debug pages show settings and source.",
           "Switch it off outside development."),
    "X2": ("Browsers apply none of the protections they offer.",
           "Set the headers for content, transport and frames."),
    "X3": ("Links to this site can lead anywhere.",
           "Allow only targets on a list."),
    "X4": ("Internal pages answer to everyone who knows the path.",
           "Put a guard before the route."),
    "X5": ("Unfinished work and its data are public.",
           "Protect previews with a sign-in."),
    "T1": ("Nothing notices when a change breaks something.",
           "Write tests and let the script run them."),
    "T2": ("The test passes whatever the code does.",
           "State what the result must be."),
    "T3": ("Tests run only when someone remembers.",
           "Run them on every change."),
}

# Names of the ten domains, keyed by the first letter of a check id.
DOMAINS = {
    "S": "Secrets and settings",
    "D": "Data access",
    "A": "Sign-in and sessions",
    "R": "Failures and their handling",
    "C": "Cost and speed",
    "P": "Dependencies",
    "O": "Logs and monitoring",
    "H": "Leftover code",
    "X": "Deployment",
    "T": "Tests",
}

# Checks that read version history and stay out of corpus statistics.
HISTORY_CHECKS = ("H1", "S4")

CHECK_IDS = [row[0] for row in CHECKS]
SEVERITY_OF = {row[0]: row[1] for row in CHECKS}


def checks(spark: SparkSession) -> DataFrame:
    """The catalog as a table."""
    return spark.createDataFrame(
        [(c, c[0], s, kind, method, done, title, *ADVICE[c]) for c, s, kind, method, done, title in CHECKS],
        "check_id string, domain string, severity string, fix_class string, "
        "method string, implemented boolean, title string, why string, fix string",
    )


def _lookup(check_id: str, position: int) -> Column:
    pairs = ", ".join(f"'{row[0]}', '{row[position]}'" for row in CHECKS)
    return F.expr(f"try_element_at(map({pairs}), {check_id})")


def severity_of(check_id: str = "check_id") -> Column:
    """Severity as a literal map of 64 entries, for filters that need no join."""
    return _lookup(check_id, 1)


def fix_class_of(check_id: str = "check_id") -> Column:
    return _lookup(check_id, 2)
