"""Entry point of the file-to-file jobs for spark-submit (see sigwin/plans/files.py)."""

from sigwin.plans.files import main

if __name__ == "__main__":
    main()
