from .settings import main

main()
